"""The pipeline and the registered corpus queries against brute force."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5
from math import floor

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stratafold.llm import packing, quality, queries
from tests.llm.test_corpus_operators import WORD, brute_components, brute_statistics, brute_targets
from tests.test_entry import compare


def documents():
    rng = np.random.default_rng(12)
    vocabulary = ["".join(map(chr, rng.integers(97, 110, rng.integers(2, 9)))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        words = [vocabulary[k] for k in rng.integers(0, 400, int(rng.integers(20, 90)))]
        good = i % 4 != 0
        if not good:
            words = [w + "%%%" for w in words]
        rows.append([i, " ".join(words), "en", f"src{i % 5 if i % 3 else 0}", 0])
        labels.append((i, int(good), 0))
    for i in range(240, 300):
        copied = rows[int(rng.integers(0, 40)) * 4 + 1]
        words = copied[1].split(" ")
        if i % 2:
            words[3] = "different"
        rows.append([i, " ".join(words), "en", "src0", 0])
    return [tuple(r) for r in rows], labels


def by_id(r):
    return r[0] is not None, r[0] or 0


def brute_pipeline(rows, labels):
    rows = [(r[0], r[1] or "", *r[2:]) for r in rows]
    x = np.array([brute_statistics(r[1]) for r in rows])
    at = {r[0]: k for k, r in enumerate(rows)}
    moments = {}
    for y in (0, 1):
        own = x[[at[i] for i, q, _ in labels if q == y and zlib.crc32(str(i).encode()) % 5]]
        moments[y] = (len(own), own.sum(axis=0), own.T @ own)
    rows = [r for r, s in zip(rows, quality.Discriminant(moments).scores(x), strict=True) if s >= 0.3]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r, key=by_id)
    rows = sorted(last.values(), key=by_id)
    groups = brute_components(rows)[1]
    first = {}
    for k, (r, g) in enumerate(zip(rows, groups, strict=True)):
        g = g if WORD.search(r[1]) else f"alone {k}"
        first[g] = min(first.get(g, r), r, key=lambda r: (r[0] is None, r[0]))
    rows = list(first.values())
    size = [len(WORD.findall(r[1])) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    own = {s: sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: (size[k], by_id(rows[k]))) for s in sources}
    targets = brute_targets([sum(size[k] for k in own[s]) for s in sources], [k % 3 + 1 for k in range(len(sources))])
    copies = {}
    for s, t in zip(sources, targets, strict=True):
        words = sum(size[k] for k in own[s])
        rate = float(t) / words if words else 0.0
        u = (int(md5(f"17|{'n' if s is None else 's' + s}".encode()).hexdigest()[:5], 16) + 0.5) / 2**20
        for n, k in enumerate(own[s], 1):
            copies[k] = floor(rate * n + u) - floor(rate * (n - 1) + u)
    encode, out = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for k, r in enumerate(rows):
        ids = [*encode.encode(r[1], add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            data = np.array(ids[start : start + 1024], "<u4").tobytes()
            out[(r[0], start, len(data) // 4, zlib.crc32(data), len(ids))] += copies[k]
    return +out


def run_pipeline(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return corpus_pipeline.run(spark, f"file://{path}").collect()


def pieces(got):
    return Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)


def test_pipeline(spark, tmp_path):
    rows, labels = documents()
    got = run_pipeline(spark, tmp_path, rows, labels)
    assert pieces(got) == brute_pipeline(rows, labels)
    room = defaultdict(int)
    for r in got:
        room[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(room.values()) <= 1024


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null, empty, blank and very long texts, null and repeated ids, null sources, repeated rows, null labels."""
    rows, labels = documents()
    long = " ".join(r[1] for r in rows[1:200] if r[0] % 4) * 3
    odd = [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (None, rows[5][1] + " more"), (None, "no id " + rows[9][1]), (304, long), (13, "again " + rows[17][1]), (1, rows[1][1]), (305, "x" * 20000)]
    rows += [(i, t, None, None if k % 2 else "src1", None) for k, (i, t) in enumerate(odd)]
    assert pieces(run_pipeline(spark, tmp_path, rows, [*labels, (None, 1, 1), (2, None, None)])) == brute_pipeline(rows, labels)


def test_pipeline_without_documents(spark, tmp_path):
    assert run_pipeline(spark, tmp_path / "a", [], documents()[1]) == []
    assert len(run_pipeline(spark, tmp_path / "b", documents()[0], [])) > 0


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(rows[:60], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/d.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, name, queries.queries()[name], queries.SQL[name])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
