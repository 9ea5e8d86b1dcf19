"""Tokenizer alignment, line removal and whitening against brute force on awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratafold.llm import alignment, line_dedup, whitening
from tests.test_entry import compare

# alignment


def brute_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    from stratafold.llm.packing import byte_of

    byte_bpe, piece_bpe = alignment.default_files()
    a = Tokenizer.from_file(byte_bpe)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
    alphabet = byte_of()

    def tokens(text):
        """[(id, bytes)] of A and of B for the whole text at once."""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        as_bytes = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids_a]
        pieces = [(i, b.id_to_piece(i)) for i in ids_b]
        return as_bytes, [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return tokens


def brute_alignment(rows, tokens):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = tokens(text) if text else ([], [])
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, k = [], 0
        for i, s, e in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e:
                links.append((i, spans[1][m][0]))
                m += 1
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        said, before = [], 0
        ends = [[e for _, _, e in side] for side in spans]
        at = [0, 0]
        for stop in shared:
            words = []
            for side in (0, 1):
                first = at[side]
                while at[side] < len(ends[side]) and ends[side][at[side]] <= stop:
                    at[side] += 1
                words.append(",".join(str(spans[side][x][0]) for x in range(first, at[side])))
            said.append("|".join(words))
            before = stop
        assert before == len(whole)
        docs.append((doc_id, len(a), len(b), len(shared), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
        counts.update(links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((d, a, b, g, len(links), sha, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)) for d, a, b, g, links, sha in docs)


ODD = ["a <|endoftext|> b <s> </s> <unk> <0x41>", "x▁y", "ﬁn é é", "  two  spaces   and trail ", "\t\n \r\n tabs\n\n  lines \n", "\x00\x01 null", " ", "\n", "a b c　 d \x1c e\x85 f", "it's they'll 'tis don't", "12345 678 ١٢٣", "你好 \U0001f600\U0001f469‍\U0001f469‍\U0001f467 नमस्ते"]


@pytest.fixture(scope="module")
def texts(rows):
    return [(r[0], r[1]) for r in rows] + [(1000 + k, t) for k, t in enumerate(ODD)]


def test_alignment(spark, texts):
    want = brute_alignment(texts, brute_tokens())
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    for heavy in (alignment.HEAVY, 7, 0):  # all pairs broadcast, some, none
        got = alignment.alignment(docs, heavy=heavy)
        assert got.columns == columns
        assert Counter(map(tuple, got.collect())) == want


def test_alignment_in_parts(spark, texts, monkeypatch):
    """Small parts, stretches that are not kept, and few pairs in memory give the same."""
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    want = Counter(map(tuple, alignment.alignment(docs).collect()))
    tables = alignment.Vocabularies(*alignment.default_files())
    whole = {t: tables.encoded(t) for _, t in texts if t}
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(alignment, "KEPT", 5)
    for text, parts in whole.items():
        small = tables.encoded(text)
        for side in (0, 1):
            assert [i for p in small for i in p[side].tolist()] == [i for p in parts for i in p[side].tolist()]
        made, again = alignment.Slice(tables, 1, True), alignment.Slice(tables, 1, True)
        for part in parts:
            made.add([0], [part[0]], [part[1]])
        for part in small:
            again.add([0], [part[0]], [part[1]])
        assert [c.to_pylist() for c in made.columns()] == [c.to_pylist() for c in again.columns()]
    assert sum(want.values()) == len(texts)


def kernel_of(spark, monkeypatch):
    """What ``aligned`` does to the texts of a slice, and the vocabularies that it does it with."""
    monkeypatch.setattr(alignment, "map_texts", lambda docs, kernel, *_: kernel)
    return alignment.aligned(spark.createDataFrame([], "doc_id bigint, text string")), alignment.vocabularies(*alignment.default_files())


def test_alignment_encodes_new_stretches_in_short_texts(spark, monkeypatch):
    """Encoders get no long text made of short stretches, and frequent stretches stay when too many are kept."""
    alignment.vocabularies.cache_clear()
    kernel, tables = kernel_of(spark, monkeypatch)
    given = {"a": [], "b": []}
    for side, name in (("a", "encode_a"), ("b", "_pieces")):
        real = getattr(tables, name)
        monkeypatch.setattr(tables, name, lambda text, side=side, real=real: given[side].append(text) or real(text))
    kernel([" ".join(f"word{k}" for k in range(5000))])
    for texts in given.values():
        assert sum(map(len, texts)) > 40_000
        assert max(map(len, texts)) < 4096
    monkeypatch.setattr(alignment, "KEPT", 50)
    for k in range(6):
        kernel(["always again " + " ".join(f"once{k}x{j}" for j in range(40))])
    for texts in given.values():
        texts.clear()
    kernel(["zz always again"])
    assert given == {"a": [" zz"], "b": [" zz"]}
    alignment.vocabularies.cache_clear()


def test_alignment_by_stretches(spark, monkeypatch):
    """Texts put together from known stretches equal brute force, whatever is kept and encoded together."""
    rng = random.Random(3)
    words = "a", "the", "über", "it's", "x\u2003", "y\u00a0", "z\u0085", "q\x1c", "", "", "\n", "\r\n", "3.14", "你好", "\u3000", "w" * 300, "\U0001f600", "<s>", "\u1680", "(a)", "\x00", "tab\t", "\u200b"
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)), "well ▁ known the a", None, "", " ", "\u2003 \u2003"]
    want = brute_alignment(enumerate(texts), brute_tokens())
    counts = Counter()
    for together, kept, part in ((1, 5, 3), (40, 20, 1 << 17), (1 << 10, 1 << 18, 7)):
        monkeypatch.setattr(alignment, "TOGETHER", together)
        monkeypatch.setattr(alignment, "KEPT", kept)
        monkeypatch.setattr(alignment, "PART", part)
        tables = alignment.Vocabularies(*alignment.default_files())
        got, seen = Counter(), Counter()
        for at in range(0, len(texts), 20):
            n_a, n_b, n_groups, n_links, sha, pairs, times, groups = (c.to_pylist() for c in alignment.slice_of(tables, texts[at : at + 20], True).columns())
            got.update((at + k, *row) for k, row in enumerate(zip(n_a, n_b, n_groups, n_links, sha, strict=True)))
            assert [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] == sha
            assert [sum(t) for t in times] == n_links
            for own, n in zip(pairs, times, strict=True):
                seen.update(dict(zip(own, n, strict=True)))
        assert got == Counter(row[:6] for row in want)
        assert not counts or seen == counts
        counts = seen
    assert any(tables.bad)


def test_alignment_gives_groups(spark):
    docs = spark.createDataFrame([(1, "hello unbelievable worlds"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in alignment.alignment(docs, with_groups=True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"]
    assert got[1]["groups"].count(";") == got[1]["n_groups"] - 1
    assert (got[2]["groups"], got[2]["groups_sha256"], got[2]["n_best"], got[2]["count_sum"]) == ("", "", 0, 0)


def test_alignment_of_nothing(nothing):
    assert alignment.alignment(nothing).count() == 0


# lines

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_lines(rows, least_docs=3, least=20):
    low = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    key = lambda line: line.strip(STRIP).translate(LOWER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc_id)
    top = {k: max(v, key=low) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def lined(rows):
    rng = random.Random(8)
    pool = [f"{'Common line that recurs often'} {k} Éİ" for k in range(12)] + ["short", "", "   ", "x" * 20, "y" * 19, "Z" * 20, "z" * 20, "\tz" + "Z" * 19 + " \r", " " + "q" * 19, "İ" * 20]
    made = [(r[0], r[1]) for r in rows]
    made += [(100 + k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 15)))) for k in range(60)]
    made += [(None, "\n".join(pool)), (None, pool[0]), (159, pool[1]), (159, "\n".join(pool)), (159, "\n".join(pool)), (7000, "\n".join([pool[2]] * 3000)), (7001, "\n" * 5), (-5, pool[3] + "\n")]
    return made


def test_line_dedup(spark, lined, monkeypatch):
    docs = spark.createDataFrame(lined, "doc_id bigint, text string").repartition(4)
    want = brute_lines(lined)
    assert Counter(map(tuple, line_dedup.line_digests(docs).collect())) == want
    monkeypatch.setattr(line_dedup, "HEAVY", 1)
    assert Counter(map(tuple, line_dedup.line_digests(docs).collect())) == want


def test_line_dedup_keeps_columns(spark, lined):
    rows = [(t, i, "x", 7, "g") for i, t in lined]
    docs = spark.createDataFrame(rows, "Body string, id bigint, gone string, place int, lines string")
    got = line_dedup.drop_common_lines(docs, doc_id="id", text="Body")
    assert got.columns == docs.columns
    found = got.collect()
    assert Counter((r["id"], hashlib.sha256((r["Body"] or "").encode()).hexdigest()) for r in found) == Counter({(k[0], k[3]): 0 for k in ()}) + Counter((k[0], k[3]) for k in brute_lines(lined).elements())
    assert sum(r["Body"] is None for r in found) == sum(t is None for _, t in lined)


def test_line_runs_in_any_order(spark):
    """Batches may come in any order; runs are compacted; what is settled is not written again."""
    rng = random.Random(4)
    docs = [(k, rng.choice("abcdefgh") + "-" * 20) for k in range(60)]
    rng.shuffle(docs)
    runs = line_dedup.LineRuns(spark, least_docs=3, fan=2)
    for k in range(0, 60, 12):
        batch = spark.createDataFrame(docs[k : k + 12], "doc_id bigint, text string")
        runs.add(line_dedup.counted(line_dedup.line_hashes(batch, line_dedup.F.lit(0))))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    holders = defaultdict(set)
    for i, t in docs:
        holders[t].add(i)
    want = {hashlib.sha256(t.encode()).digest()[:16]: max(v) for t, v in holders.items() if len(v) >= 3}
    assert {bytes(r["key"]): r["top"] for r in runs.common().collect()} == want
    names = [n for level in runs.levels for n in level]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.line_digests(nothing).count() == 0


def test_line_dedup_matches_its_sql(spark):
    from stratafold.llm.queries import SQL, queries

    compare(spark, "op12_line_dedup", queries()["op12_line_dedup"], SQL["op12_line_dedup"])


# whitening


def brute_whitening(vectors, k=8):
    """(n, deviations, covariance, eigenvalues, axes) in whole numbers and long doubles where it matters."""
    x = [[int(np.floor(c * 1024)) + 100000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    gap = [[n * c - s for c, s in zip(v, total, strict=True)] for v in x]
    y = np.array([[g / n for g in v] for v in gap])
    v = sum(np.outer(r, r) for r in y) / n
    e, axes = np.linalg.eigh(v)
    return n, [sum(g * g for g in r) for r in gap], v, e[::-1][:k], axes[:, ::-1][:, :k], y


def check_whitening(got, ids, vectors, k=8):
    n, deviations, v, e, axes, y = brute_whitening(vectors, k)
    k = min(k, len(v))
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c + 1) for i in ids for c in range(k))
    want = {i: (d, r) for i, d, r in zip(ids, deviations, y, strict=True)}
    for c in range(k):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        flat = e[c] <= np.trace(v) * len(v) * np.finfo(float).eps
        signs = set()
        for i, (d, r) in want.items():
            m = mine[i]
            assert (m["n"], m["deviation"]) == (n, d if d < 2**63 else None)
            assert m["explained"] == pytest.approx(max(e[c], 0) / np.trace(v), rel=1e-9, abs=1e-15)
            if flat:
                assert m["whitened"] is None
                continue
            w = float(r @ axes[:, c]) / e[c] ** 0.5
            assert abs(m["whitened"]) == pytest.approx(abs(w), abs=1e-7)
            if abs(w) > 1e-6:
                signs.add(np.sign(m["whitened"]) == np.sign(w))
        assert len(signs) <= 1
    assert len({r["identity_error"] for r in got}) == 1


SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, whitened string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA).repartition(parts)


def test_whitening(spark, monkeypatch):
    rng = np.random.default_rng(2)
    good = [[float(np.float32(c)) for c in rng.standard_normal(12) * np.linspace(0.2, 3, 12) + 5] for _ in range(150)]
    rows = list(enumerate(good))
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] + [0.0] * 11), (904, [float("inf")] + [0.0] * 11), (905, [3e38] + [0.0] * 11)]
    monkeypatch.setattr(whitening, "CHUNK", 16)
    got = whitening.whiten(table(spark, rows + bad)).collect()
    check_whitening(got, [i for i, _ in rows], good)
    assert got[0]["identity_error"] < 1e-9


def test_whitening_far_from_zero(spark):
    """A mean of a million times the deviation costs no digits; whole numbers beyond 64 bits stay exact."""
    rng = np.random.default_rng(3)
    for scale, shift in ((2**-9, 2**13), (2.0**40, 2.0**50)):
        vectors = [[float(np.float32(c)) for c in rng.integers(-512, 512, 5) * scale + shift] for _ in range(40)]
        got = whitening.whiten(table(spark, list(enumerate(vectors)))).collect()
        check_whitening(got, list(range(40)), vectors)
        assert got[0]["identity_error"] < 1e-6


def test_whitening_without_variance(spark):
    line = [[float(k), 2.0 * k, 1.0] for k in range(6)]
    got = whitening.whiten(table(spark, [(None, line[0]), *enumerate(line[1:])], 2)).collect()
    assert [r["whitened"] is None for r in sorted(got, key=lambda r: r["component"])] == [False] * 6 + [True] * 12
    same = whitening.whiten(table(spark, [(1, [2.0, 3.0])] * 3)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    single = whitening.whiten(table(spark, [(1, [2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"]) for r in single] == [(1, 1, 0)]
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0


def test_whitening_of_other_lengths(spark):
    rng = np.random.default_rng(6)
    short, long = ([[float(np.float32(c)) for c in rng.standard_normal(d)] for _ in range(30)] for d in (3, 9))
    got = whitening.whiten(table(spark, [*enumerate(short), *((100 + k, v) for k, v in enumerate(long))])).collect()
    check_whitening([r for r in got if r["vec_id"] < 100], list(range(30)), short)
    check_whitening([r for r in got if r["vec_id"] >= 100], list(range(100, 130)), long)
