"""Words of ASCII letters are spelt for the model as they are, and have the library's ids."""

import pytest

pytest.importorskip("public_tokenizers")


def test_ascii_words_go_straight_to_the_model(monkeypatch):
    import public_tokenizers

    from tessera.llm.tokens import TextEncoder

    encoder, spelt = TextEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    plain = encoder._word
    monkeypatch.setattr(encoder, "_word", lambda text: spelt.append(text) or plain(text))
    texts = ["Start word Zyxwvqk word, zürich qqfoo; word\nline ünder\nqqfoo", "qqfoo straße zürich, Zyxwvqk.", "word word", "", "a  b", "\nqqbar qqbar"]
    for _ in range(2):  # the second time from memory
        assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert spelt and not {" word", " Zyxwvqk"} & set(spelt), spelt
