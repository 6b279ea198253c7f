"""Every registered query on a small folder: its contract, and its SQL where it has some."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import WORDS, prose

from tessera.llm import queries
from tessera.llm.common import fresh, ordered_sample

pytest.importorskip("public_tokenizers")
TOXIC = ["vilespawn", "grumbleworth"]


@pytest.fixture(scope="module")
def corpus(rows):
    rng = random.Random(21)
    out = [(i, t, ("en", "xx")[i % 2], s, n) for i, t, _, s, n, *_ in rows if i is not None]
    for i in range(200, 320):
        text = prose(rng, WORDS, rng.randint(60, 90))
        words = text.split(" ")
        if i % 5 == 0:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(TOXIC)
        text = " ".join(words) if i % 2 == 0 else " ".join(w[::-1].upper() for w in words)
        out.append((i, text, ("en", "xx")[i % 2], "host", len(text)))
    return out


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200, 320)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(50, vectors[3][1]), (7, vectors[7][1]), (400, None), (None, vectors[0][1]), (450, [float("nan")] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return path


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def ids_of(corpus, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary(queries.BYTE_BPE))
    return [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, *end], "<u4").tobytes()) for i, t, *_ in corpus]


def test_sql_twins(spark, folder):
    for name, sql in queries.ORACLES.items():
        with duckdb.connect() as db:
            for table in ("documents", "embeddings"):
                db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
            want = db.execute(sql)
            names = [c[0] for c in want.description]
            want = want.fetchall()
        found = [tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, folder).collect()]
        order = lambda x: tuple((v is None, v) for v in x)
        assert sorted(found, key=order) == sorted(want, key=order) and want, name


def test_op1(spark, folder, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECE_BPE))
    found = sorted((r.doc_id, r.n_pieces, r.ids_crc32) for r in queries.QUERIES["op1_sentencepiece"](spark, folder).collect())
    ids = [(i, np.array(library.encode(t or ""), "<u4")) for i, t, *_ in corpus]
    assert found == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)


def test_op2(spark, folder, corpus):
    from xxhash import xxh64_intdigest

    def print_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, print_of(t)) for i, t, *_ in corpus]
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    every = sorted(root)
    for a in every:
        for b in every:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    first = {}
    for i, p in prints:
        first[find(p)] = min(i, first.get(find(p), i))
    found = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op2_simhash"](spark, folder).collect())
    assert found == sorted((i, f"{p:016x}", first[find(p)]) for i, p in prints)


def test_op3(spark, folder, corpus):
    found, by = queries.QUERIES["op3_packing"](spark, folder).collect(), {}
    sequences = {}
    for r in found:
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, ids in ids_of(corpus, [1]):
        want.setdefault((i, len(ids) // 4), []).append(ids)
    assert by.keys() == want.keys()
    for k, pieces in by.items():
        times = len(want[k])
        assert sum(n for _, n, _ in pieces) == times * k[1]
        for a, n, c in pieces:
            assert any(zlib.crc32(ids[4 * a : 4 * (a + n)]) == c for ids in want[k])
    padding = tokens = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * tokens


def test_op4(spark, folder, corpus):
    found = queries.QUERIES["op4_token_files"](spark, folder).collect()
    want = ids_of(corpus, [2])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted((i, len(x) // 4, zlib.crc32(x)) for i, x in want)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted(i for i, _ in want)


def test_op6(spark, folder, corpus):
    found = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, folder).collect()}
    assert all(found[i].held_out == held(i, 4, 2) and 0 <= found[i].score <= 1 and found[i].predicted == (found[i].score >= 0.3) for i, *_ in corpus)
    wrong = [i for i in range(200, 320) if found[i].held_out and found[i].predicted != (i % 5 == 0)]
    assert len(wrong) <= 2, wrong


def test_op8(spark, folder, corpus):
    found = {r.doc_id: r for r in queries.QUERIES["op8_language"](spark, folder).collect()}
    texts = {i: t for i, t, *_ in corpus}
    assert all(found[i].held_out == held(i, 3, 1) and 0 <= found[i].score <= 1 for i in texts)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or "")) for i, r in found.items())
    assert all(found[i].lang_pred == ("en", "xx")[i % 2] for i in range(200, 320))


def test_op8_learns_nothing_from_held_out_rows(spark, corpus, tmp_path):
    other = [(i, t, "zz" if held(i, 3, 1) else lang, s, n) for i, t, lang, s, n in corpus]
    spark.createDataFrame(other, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.lang_pred for r in queries.QUERIES["op8_language"](spark, str(tmp_path)).collect()} == {"en", "xx", "und"}


def test_op9(spark, folder, corpus):
    """Nothing goes that hasn't stood earlier: every removed span's 20-word windows stand in what comes before it."""
    found = queries.QUERIES["op9_substring_dedup"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in corpus)
    texts = {i: t for i, t, *_ in corpus}
    seen = set()
    for r in sorted(found, key=lambda r: r.doc_id):
        own = (texts[r.doc_id] or "").lower().split()
        windows = [tuple(own[k : k + 20]) for k in range(len(own) - 19)]
        inside = {w for k, w in enumerate(windows) if w in windows[:k]}
        for s in r.removed_spans:
            gone = texts[r.doc_id][s.start : s.end].lower().split()
            assert len(gone) >= 20 and all(tuple(gone[k : k + 20]) in seen or tuple(gone[k : k + 20]) in inside for k in range(len(gone) - 19)), r.doc_id
        seen.update(windows)


def test_op10(spark, folder, corpus):
    lengths = sorted(len(x) // 4 for _, x in ids_of(corpus, []))
    for r in queries.QUERIES["op10_length_histogram"](spark, folder).collect():
        longer = [n for n in lengths if n >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.length), len(longer), sum(longer))
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)


def test_clashing_columns(spark):
    """Columns named like the operators' own ones stay as they are."""
    from tessera.llm import near_copies, passages, simhash

    text = " ".join(f"w{i}" for i in range(40))
    names = ["_print", "_PRINT", "fp", "root", "component_id", "n", "_hash", "_text", "_cut", "_chains", "_doc_id", "_text_hash", "_root", "_n", "_component_id", "set"]
    names = [n for n in names if n != "_PRINT"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    frame = spark.createDataFrame([(i, text if i < 3 else text[::-1], *range(len(names))) for i in range(4)], schema)
    for f in (simhash.keep_first, near_copies.keep_first):
        kept = f(frame)
        assert kept.columns == frame.columns and sorted((r.doc_id, *r[2:]) for r in kept.collect()) == [(0, *range(len(names))), (3, *range(len(names)))]
    left = passages.deduplicated(frame)
    assert left.columns == frame.columns and sorted((r.doc_id, r.text, *r[2:]) for r in left.collect())[1] == (1, "", *range(len(names)))
    assert fresh(frame, "_Cut", "x", "x") == ["__Cut", "x", "_x"]


def test_sample_of_hot_groups(spark):
    rows = [(i, "hot" if i % 10 else "cold", i, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, _mix int, _size int")
    found = ordered_sample(frame, "doc_id", 50, "lang").collect()
    assert len(found) == 100 and sorted(found)[0] == sorted(ordered_sample(frame.repartition(5), "doc_id", 50, "lang").collect())[0]
    assert sum(r.lang == "hot" for r in found) == 50 and frame.columns == ordered_sample(frame, "doc_id", 50, "lang").columns
