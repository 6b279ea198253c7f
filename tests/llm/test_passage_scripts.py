"""Texts in capitals, title case and other scripts: known words never add up to a passage."""

import random

from conftest import WORDS, vocabulary

from tessera.llm import passages, queries


def test_single_words_never_add_up(spark, tmp_path):
    """Texts in capitals, title case and Cyrillic whose every word stood before: nothing repeats, nothing goes."""
    rng = random.Random(12)
    cyrillic = vocabulary(200, 3, "ка ло не по во та ри")
    rows = []
    for i in range(60):
        words = [rng.choice(cyrillic if i % 3 == 2 else WORDS) for _ in range(120)]
        rows.append((i, " ".join(w.upper() if i % 3 == 0 else w.title() if i % 3 == 1 else w for w in words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op9_substring_dedup(spark, str(tmp_path)).collect()}
    assert all(found[i].text == t and not found[i].removed_spans for i, t in rows)


def test_pieces_of_several_documents_make_no_passage(spark):
    """Two stretches of 15 words of different documents side by side aren't one passage of 30."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[10:25], *b[30:45]])), (4, " ".join([*a[10:35], *b[30:55]]))]
    found = {r.doc_id: r.n_removed_units for r in passages.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 50}
