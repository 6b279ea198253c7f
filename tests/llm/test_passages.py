"""Removal of repeated passages wherever they stand: inside lines, in lower case, in the middle of sentences."""

import random

from conftest import WORDS

from tessera.llm import passages, queries


def op9(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r for r in queries.op9_substring_dedup(spark, str(tmp_path)).collect()}


def test_passages_inside_lines_go_whole(spark, tmp_path):
    """Lower-case prose without sentence ends, and passages that begin and end inside sentences; 20 words and more, not 19."""
    rng, rows, own = random.Random(4), [], {}
    for k, n in enumerate([19, 20, 21, 35, 51, 58, 120]):
        passage = [rng.choice(WORDS) for _ in range(n)]
        for j in range(3):
            a, b = ([f"own{k}x{j}x{side}x{i}" for i in range(40)] for side in "ab")
            sentence = [w.capitalize() + ("." if k % 2 and i % 17 == 16 else "") if k % 2 and i % 17 == 0 else w for i, w in enumerate(passage)]
            own[10 * k + j] = (" ".join([*a, *b]) if n >= 20 and j else " ".join([*a, *sentence, *b])), n if n >= 20 and j else 0
            rows.append((10 * k + j, " ".join([*a, *sentence, *b])))
    found = op9(spark, rows, tmp_path)
    texts = dict(rows)
    for i, (text, n) in own.items():
        assert (found[i].text, found[i].n_removed_units) == (text, n), i
        assert sum(len(texts[i][s.start : s.end].split()) for s in found[i].removed_spans) == n


def test_edges(spark, documents, nothing, rows):
    rng = random.Random(2)
    line = " ".join(rng.choice(WORDS) for _ in range(30))
    own = spark.createDataFrame([(1, f"{line}\n{line}\nend"), (None, line), (2, None), (3, ""), (4, line.upper()), (4, line.upper())], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.text) for r in passages.removals(own).collect() if r.text is not None)
    assert found == [(0, line), (1, f"{line}\nend"), (3, ""), (4, ""), (4, "")]
    clean = passages.deduplicated(documents)
    assert clean.columns == documents.columns and clean.count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())
    assert passages.removals(nothing).collect() == [] and passages.deduplicated(nothing).collect() == []
