"""Every corpus operator against brute force on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import exact_dedup, jaccard, joins, licenses, mixing, near_vectors, packing, quality, repeats, secrets, shingles, toxicity
from stratafold.llm import queries as corpus_queries

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def bag(rows):
    return Counter(tuple(r) for r in rows)


# 1


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return bag((r[0], len(sets[i]), name[find(i)]) for i, r in enumerate(rows)), [find(i) for i in range(len(rows))]


def test_jaccard_join(corpus, rows):
    got = jaccard.jaccard_components(corpus).collect()
    assert bag(got) == brute_components(rows)[0]


def test_jaccard_join_with_shuffled_ids(corpus, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", -1)
    monkeypatch.setattr(jaccard, "PART", 3)
    assert bag(jaccard.jaccard_components(corpus).collect()) == brute_components(rows)[0]


def test_one_per_component(corpus, rows):
    kept = jaccard.keep_one_per_component(corpus)
    assert kept.columns == corpus.columns
    groups = brute_components(rows)[1]
    empty = [i for i, r in enumerate(rows) if not shingle_set(r[1])]
    expected = len({g for i, g in enumerate(groups) if i not in empty}) + len(empty)
    assert kept.count() == expected


def test_many_near_copies_of_one_text(spark, tmp_path):
    base = [f"w{i}" for i in range(150)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.choice(150, rng.integers(0, 22), replace=False):
            w[k] = f"z{i}_{k}"
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"file://{tmp_path}/d")
    got = jaccard.jaccard_components(spark.read.parquet(f"file://{tmp_path}/d")).collect()
    assert bag(got) == brute_components(rows)[0]


def test_signatures_are_guaranteed():
    """Linked sets share as many signatures as guaranteed; where a set's t is 0 its band is signed by shingles."""
    rng = np.random.default_rng(3)
    ends = jaccard.band_ends()
    for n in (1, 2, 5, 24, 25, 40, 77, 150, 700):
        for _ in range(60):
            pool = rng.integers(0, 2**63, 3 * n + 4, dtype=np.uint64)
            a = np.sort(pool[:n])
            cut = int(rng.integers(0, n // 4 + 1))
            b = np.sort(np.concatenate((a[cut:], pool[n : n + int(rng.integers(0, n // 4 + 1))])))
            k = len(np.intersect1d(a, b))
            if not k or 100 * k < 75 * (len(a) + len(b) - k):
                continue
            for fine in (frozenset(), frozenset(range(200))):
                signs, rows, sure = jaccard.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), fine=fine)
                mine, other = signs[rows == 0], signs[rows == 1]
                shared = np.intersect1d(mine, other)
                met = max(np.searchsorted(ends, len(a)), np.searchsorted(ends, len(b))) & 1
                assert (shared & np.uint64(1) == met).sum() >= max(sure[0, met], sure[1, met])


def test_no_set_is_without_a_guarantee():
    """Of all sizes to 400: t is 1 or more, or the band is signed by shingles, where it always is."""
    rng = np.random.default_rng(11)
    ends, lost = jaccard.band_ends(), 0
    for n in range(1, 401):
        sizes = np.full(300 if n < 40 else 20, n)
        hashes = np.sort(rng.integers(0, 2**63, (len(sizes), n), dtype=np.uint64), axis=1)
        if n < 30:  # crowded into few partitions, as chance does now and then
            hashes[::7] = np.sort(hashes[::7] >> np.uint64(2), axis=1)
        _, _, sure = jaccard.signatures(hashes.ravel(), sizes)
        band = int(np.searchsorted(ends, n))
        fine = frozenset(b for b in (band, band + 1) if (sure[:, b & 1] < 1).any())
        lost += len(fine)
        assert (jaccard.signatures(hashes.ravel(), sizes, fine=fine)[2] > 0).all()
    assert lost


def test_links_of_sets_that_fill_few_partitions(spark, tmp_path):
    text = "tojl wcdzsi vfdg vsxtwok vyrep fruw qvvxp kwi gnntjno wbvudawh mxblenaq pgzrodso ngasvt eluvuzk smso vnr pfjasklc gwnsowx qfmq cldl aigecyjf nstbmsjw"
    rows = [(1, text), (2, text + " ixrunx wshorp aywzf usjlkp aqdqvq gkcg"), (3, " ".join(f"w{k}" for k in range(30)))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert jaccard._guaranteed(jaccard._described_docs(docs, None, "doc_id", "text"))[1]


def test_shingles_match_words(rows):
    texts = [r[1] for r in rows]
    hashes, sizes = shingles.shingle_sets(texts)
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]
    seen = {}
    for part, text in zip(np.split(hashes, np.cumsum(sizes)[:-1]), texts, strict=True):
        assert seen.setdefault(part.tobytes(), shingle_set(text)) == shingle_set(text)


# 2


def brute_secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_scan(spark, corpus):
    body = "A" * 30
    good = "ghp_" + body + secrets.base62_crc(body)
    texts = [None, "", "token = 'abcdef12'", "é TOKEN:short api-key=abcdefgh", "apikey=abcdef AKIA" + "Q7" * 9, "x" + "0123456789abcdef" * 2 + "g", "password password=longenough secret=\"hidden_value\"", good, good[:-1] + "!", "ghp_" + "B" * 36, "K" * 3 + "token=Kelvin1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[4])]
    got = secrets.secret_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    expected = Counter()
    for i, t in rows:
        base = brute_secrets(t)
        kinds = Counter(k for k, _, _ in base)
        more = [("github", t.index(good), t.index(good) + len(good))] if t == good else []
        everything = sorted(base + more, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        expected[(i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(secrets.joined(base).encode()).hexdigest(), secrets.joined(everything))] += 1
    assert bag(got) == expected
    assert secrets.secret_digests(corpus).count() == corpus.count()


# 3


def brute_targets(sizes, weights):
    total, targets, open_ = Fraction(sum(sizes)), [None] * len(sizes), set(range(len(sizes)))
    while True:
        left = total - sum(t for t in targets if t is not None)
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > 3 * sizes[i]] if open_ else []
        if not over:
            return [targets[i] if targets[i] is not None else left * weights[i] / weight for i in range(len(sizes))]
        for i in over:
            targets[i] = Fraction(3 * sizes[i])
            open_.discard(i)


def test_mixing(corpus, rows):
    got = mixing.sampled(corpus).collect()
    assert len(got) == len(rows)
    size = {(r[0], r[1], r[3]): len(WORD.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[(r[0], r[1], r[3])] for r in rows if r[3] == s) for s in sources]
    wanted = brute_targets(sizes, [i % 3 + 1 for i in range(len(sources))])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size[(r[0], r[1], r[3])]) for r in rows)
    for s, t in zip(sizes, wanted, strict=True):
        mine = [r for r in got if r["source_size"] == s]
        assert all(abs(r["target"] - float(t)) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - float(t)) <= max(r["size"] for r in mine)
    again = mixing.sampled(corpus).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix(corpus)
    assert mixed.columns == corpus.columns
    assert mixed.count() == sum(r["copies"] for r in got)


# 4


def test_packing(corpus, rows):
    got = packing.pack(corpus, with_ids=True)
    table = got.collect()
    encode = Tokenizer.from_file(packing.default_tokenizer())
    expected = Counter()
    for r in rows:
        ids = [*encode.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            data = np.array(ids[start : start + 1024], "<u4").tobytes()
            expected[(r[0], start, len(data) // 4, zlib.crc32(data), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in table) == expected
    by = defaultdict(list)
    for r in table:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.1 * sum(r["length"] for r in table) / 1024 + 2
    whole = packing.sequences(got).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)


def test_special_tokens_in_texts(spark):
    """The contract's tokenizer, untouched, against both of ours."""
    untouched = Tokenizer.from_file(packing.default_tokenizer())
    ours = packing.encoder(packing.default_tokenizer())
    assert ours.fast is not None
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "a <|endoftext|>" + "z" * 2500, "<|startoftext|> <s>"):
        assert ours(text) == untouched.encode(text, add_special_tokens=False).ids
    assert ours("a <|endoftext|> b") == [64, 220, 50256, 275]
    plain = packing.encoder(packing.default_tokenizer(), plain=True)
    assert 50256 not in plain("a <|endoftext|> b") and plain("ab cd") == ours("ab cd")


def test_best_fit_is_tightest():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 400)
    number, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[k]]
        room = min(fits) if fits else 64
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[k])
    mine = [64 - lengths[number == w].sum() for w in range(number.max() + 1)]
    assert sorted(mine) == sorted(rooms)


# 5


def brute_dice(a, b):
    grams = lambda t: Counter(zip(w := re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(LOWER)), w[1:], strict=False))
    x, y = grams(a), grams(b)
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def test_license_scan(spark, corpus):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("person", "human").replace("Software", "Programme", 1)
    texts = [None, "", "word", mit, changed, "some words before " * 30 + changed + " and after it" * 40, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", mit[: len(mit) // 3]]
    got = {r["doc_id"]: r for r in licenses.license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    names = {i: [m["name"] for m in r["licences"]] for i, r in got.items()}
    assert names == {0: [], 1: [], 2: [], 3: ["MIT"], 4: ["MIT"], 5: ["MIT"], 6: ["MIT notice", "CC-BY-NC-4.0 notice"], 7: []}
    assert got[4]["licences"][0]["dice"] == pytest.approx(brute_dice(changed, mit))
    for i, text in enumerate(texts):  # whole texts: the same as comparing with every template
        best = max((brute_dice(text, t) for t in licenses.TEMPLATES.values()), default=0.0)
        if best >= licenses.THRESHOLD:
            assert max(m["dice"] for m in got[i]["licences"]) >= best - 1e-12
    assert licenses.license_scan(corpus).count() == corpus.count()


def brute_licenses(numbers, templates, threshold):
    """Every window of every length, the best first."""
    n = len(numbers)
    windows = [(templates.dice(k, numbers[i:j]), j - i, name, i) for k, name in enumerate(templates.names) for i in range(n) for j in range(i + 1, n + 1)]
    chosen = []
    for value, length, name, start in sorted((w for w in windows if w[0] >= threshold), key=lambda w: (-w[0], -w[1], w[2], w[3])):
        if all(start + length + 1 <= low or start >= high for _, _, low, high in chosen):
            chosen.append((name, value, start, start + length + 1))
    return sorted(chosen, key=lambda m: m[2])


def test_license_windows_of_every_length():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdef")
    finds = 0
    for case in range(150):
        texts = {f"t{k}": [word() for _ in range(rng.randint(2, 12))] for k in range(3)}
        body = [word() for _ in range(rng.randint(0, 8))]
        for t in rng.choices(list(texts.values()), k=3):
            body += [w for x in t for w in ([] if rng.random() < 0.1 else [x, "zz"] if rng.random() < 0.1 else [x])] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
        known = licenses.Templates({k: " ".join(t) for k, t in texts.items()})
        numbers = known.numbers(licenses.bigrams([" ".join(body)])[0])
        for threshold in (0.8, 0.6):
            want = brute_licenses(numbers, known, threshold)
            assert licenses.found(numbers, known, threshold) == want, case
            finds += len(want)
    assert finds > 300


def test_license_lengthened_or_shortened_within_a_document():
    """120 words within 1000 others: a foreign word after every 8, and only the first 84 or 90."""
    licence = [f"l{i}" for i in range(120)]
    known = licenses.Templates({"it": " ".join(licence)})
    longer = [w for i, x in enumerate(licence) for w in ([x, f"f{i}"] if i % 8 == 7 and i < 119 else [x])]
    for kept in (longer, licence[:84], licence[:90]):
        around = [f"o{i}" for i in range(1000)]
        inside, alone = (licenses.found(known.numbers(licenses.bigrams([" ".join(t)])[0]), known) for t in ([*around[:500], *kept, *around[500:]], kept))
        assert [(name, start, end) for name, _, start, end in inside] == [("it", 500, 500 + len(kept))]
        assert [m[:2] for m in inside] == [m[:2] for m in alone]


# 6


@pytest.mark.parametrize(("heavy", "broadcast"), [(1, 0), (256, 1 << 14)])
def test_exact_dedup(corpus, rows, monkeypatch, heavy, broadcast):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    monkeypatch.setattr(joins, "BROADCAST_BITMAPS", broadcast)
    got = exact_dedup.exact_duplicates(corpus).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    left = exact_dedup.drop_exact_duplicates(corpus)
    assert left.columns == corpus.columns
    assert Counter(r["text"] or "" for r in left.collect()) == Counter(dict.fromkeys(groups, 1))


# 7


def brute_repeats(rows, length):
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[x : x + length] for _, b in bodies for x in range(len(b) - length + 1))
    out = Counter()
    for i, b in bodies:
        gone = repeats.merged([(x, x + length) for x in range(len(b) - length + 1) if seen[b[x : x + length]] > 1])
        kept = bytearray(b)
        for start, end in gone[::-1]:
            del kept[start:end]
        out[(i, len(b), len(b) - len(kept), len(gone), hashlib.sha256(bytes(kept)).hexdigest())] += 1
    return out


def test_words_that_a_polynomial_confuses():
    """Thue-Morse words of 1024 letters: different words, equal under any polynomial modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    hashes, _ = shingles.word_hashes([one + " " + other])
    assert hashes[0] != hashes[1]


def test_equal_hashes_of_different_sets(corpus, rows, monkeypatch):
    """Nodes cut down to four values: the second hash tells sets apart."""
    want = bag(jaccard.jaccard_components(corpus).collect())
    real, described = jaccard.nodes_of, jaccard._described_docs
    few = F.shiftright("node", 8).bitwiseAND(F.lit(3)).bitwiseOR(F.lit(1))
    monkeypatch.setattr(jaccard, "nodes_of", lambda hashes, sizes: np.where(sizes > 0, (real(hashes, sizes) >> 8) & 3 | 1, 0))
    monkeypatch.setattr(jaccard, "_described_docs", lambda *a: described(*a).withColumn("node", F.when(F.col("n_shingles") > 0, few).otherwise(F.lit(0))))
    assert described(corpus.withColumn("rid", F.monotonically_increasing_id()), "rid", "doc_id", "text").where("n_shingles > 0").select(few).distinct().count() <= 2
    assert bag(jaccard.jaccard_components(corpus).collect()) == want


@pytest.mark.parametrize("broadcast", [0, 1 << 14])
def test_marks_of_rows(spark, monkeypatch, tmp_path, broadcast):
    """Partitions with several bitmaps, and parts of them without a mark."""
    monkeypatch.setattr(joins, "BROADCAST_BITMAPS", broadcast)
    spark.range(0, 300_000, 1, 3).withColumn("text", F.lit("x")).write.parquet(f"file://{tmp_path}/d")
    docs = joins.numbered(spark.read.parquet(f"file://{tmp_path}/d"))
    mark = F.when((F.col("id") < 40_000) | (F.col("id") > 160_000), F.col("id") % 7 % 6)
    marks = docs.select(joins.RID, mark.alias(joins.MARK)).where(F.col(joins.MARK) > 0)
    got = joins.marked(docs, marks, 5)
    assert got.columns == [*docs.columns, joins.MARK] and got.count() == 300_000
    assert got.where(F.col(joins.MARK) != F.coalesce(mark, F.lit(0))).count() == 0
    kept = joins.without(docs, marks.select(joins.RID))
    assert kept.count() == got.where(F.col(joins.MARK) == 0).count() and kept.where(mark > 0).count() == 0


def test_numbers_are_places_in_files(spark, corpus):
    assert joins.steady(corpus) is corpus
    held = corpus.where("doc_id > 1").select("doc_id", "text")
    assert joins.steady(held) is held
    for moving in (corpus.repartition(3), corpus.distinct(), corpus.sample(0.5, 1), spark.createDataFrame([(1, "x")], "doc_id bigint, text string")):
        assert joins.steady(moving) is not moving
    shuffled = corpus.repartition(5)
    assert exact_dedup.drop_exact_duplicates(shuffled).count() == exact_dedup.drop_exact_duplicates(corpus).count()
    with pytest.raises(ValueError, match="__sf_rid"):
        joins.numbered(corpus.withColumn(joins.RID, F.lit(1)))


def test_results_survive_another_number_of_cores(spark, tmp_path):
    """Files are split anew between building a plan and running it: a row keeps its number, so decisions hit the rows they were made of."""
    copies = [(k, f"text number {k % 400} of a corpus with copies and some more words", f"s{k % 3}") for k in range(3000)]
    rows = copies + [(5000 + k, " ".join(f"w{(k // 3) * 50 + j}" for j in range(40)) + f" tail{k}", "s0") for k in range(60)]
    path = f"file://{tmp_path}/d"
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(2).write.option("parquet.block.size", 2048).option("parquet.page.size", 512).parquet(path)
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    held = {k: spark.conf.get(k, None) for k in keys}
    told = {}
    try:
        for name, act in (("exact", exact_dedup.drop_exact_duplicates), ("near", jaccard.keep_one_per_component), ("mix", mixing.mix), ("repeats", lambda d: repeats.without_repeats(d).drop("kept"))):
            for parallelism, after in ((2, 2), (2, 13)):
                spark.conf.set(keys[1], "1024")
                spark.conf.set(keys[0], str(parallelism))
                made = act(spark.read.parquet(path))
                spark.conf.set(keys[0], str(after))
                told.setdefault(name, []).append(bag(made.select("*").collect()))
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name, found in told.items():
        assert found[0] == found[1], name
    assert sum(told["exact"][0].values()) == 400 + 60


def brute_passages(rows, words):
    """Words in passages of so many words that stand in another row, too."""
    bodies = [re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    holders = defaultdict(set)
    for n, body in enumerate(bodies):
        for x in range(len(body) - words + 1):
            holders[tuple(body[x : x + words])].add(n)
    shared = [repeats.merged([(x, x + words) for x in range(len(b) - words + 1) if len(holders[tuple(b[x : x + words])]) > 1]) for b in bodies]
    return Counter((r[0], sum(end - start for start, end in spans)) for r, spans in zip(rows, shared, strict=True))


@pytest.mark.parametrize(("split", "chunk", "broadcast"), [(1500, 1_000_000, 500_000), (1, 3000, 0)])
def test_repeats(corpus, rows, monkeypatch, split, chunk, broadcast):
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "BROADCAST_PLACES", broadcast)
    assert bag(repeats.without_repeats(corpus, 60, 20).drop("kept").collect()) == brute_repeats(rows, 60)


@pytest.mark.parametrize("split", [1500, 2])
def test_shared_words(corpus, rows, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    assert bag(repeats.shared_words(corpus, 12, 4).collect()) == brute_passages(rows, 12)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_repeats_and_passages_together(corpus, rows, nothing, monkeypatch, broadcast):
    monkeypatch.setattr(repeats, "BROADCAST_PLACES", broadcast)
    got = repeats.without_repeats(corpus, 60, 20, passages=12, passage_gram=4).drop("kept").collect()
    assert bag(r[:5] for r in got) == brute_repeats(rows, 60)
    assert bag((r["doc_id"], r["n_shared_words"]) for r in got) == brute_passages(rows, 12)
    assert repeats.without_repeats(nothing, passages=50).columns[-2:] == ["n_shared_words", "kept"]
    assert repeats.without_repeats(nothing, passages=50).count() == 0


@pytest.mark.parametrize(("split", "chunk"), [(1500, 500_000), (2, 500)])
def test_shared_words_of_a_text_that_repeats_them(spark, tmp_path, monkeypatch, split, chunk):
    """Every place of a passage counts, also where its surroundings in a text are equal, and in texts of one word."""
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = np.random.default_rng(12)
    words = lambda n: ["".join(map(chr, rng.integers(97, 123, 4))) for _ in range(n)]
    passage, before, after = words(20), words(60), words(60)
    around = [*before, *passage, *after]
    texts = [around * 4, passage, [*words(9), *passage, *words(9), *passage], ["wall"] * 700, ["wall"] * 30, around[70:], words(40) * 3]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(f"file://{tmp_path}/d")
    assert bag(repeats.shared_words(spark.read.parquet(f"file://{tmp_path}/d"), 12, 4).collect()) == brute_passages(rows, 12)


def test_query_tells_passages_shorter_than_its_strings(spark, tmp_path):
    """Over 50 short words in two texts: no 400 bytes to cut, but words that the query counts."""
    rng = np.random.default_rng(11)
    words = lambda n: ["".join(map(chr, rng.integers(97, 123, 4))) for _ in range(n)]
    passage, again = words(60), words(55)
    texts = [[*words(80), *passage, *words(70)], [*words(30), *passage], [*again, *words(20), *again], words(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(4, None), (5, "\n".join(w.upper() for w in passage[5:57]))]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_queries.op7_repeats(spark, f"file://{tmp_path}").collect()
    assert bag(r[:5] for r in got) == brute_repeats(rows, 400)
    assert {r["doc_id"]: r["n_removed"] for r in got} == dict.fromkeys(range(6), 0)
    assert {r["doc_id"]: r["n_shared_words"] for r in got} == {0: 60, 1: 60, 2: 0, 3: 0, 4: 0, 5: 52}


def test_longer_anchor_strings_end_at_the_window():
    for length, gram in ((400, 128), (50, 16), (60, 20), (100, 99), (12, 4)):
        seen = [gram]
        while seen[-1] < length:
            seen.append(repeats.longer(seen[-1], length))
            assert seen[-2] < seen[-1] <= length and len(seen) < 12


@pytest.mark.parametrize("keep", ["none", "first"])
def test_one_passage_in_many_texts(spark, monkeypatch, tmp_path, keep):
    """An anchor string whose segments all differ, parted by longer ones again and again."""
    monkeypatch.setattr(repeats, "SPLIT", 6)
    rng = np.random.default_rng(7)
    text = lambda n: "".join(map(chr, rng.integers(97, 99, n)))  # noqa: E731  two letters: contexts repeat in part
    passage = "".join(map(chr, rng.integers(97, 123, 70)))
    rows = [(i, text(60) + passage[: 40 + i % 31] + text(60)) for i in range(60)] + [(70, passage + passage), (71, passage[5:] + passage)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    got = repeats.without_repeats(docs, 60, 20, keep)
    if keep == "none":
        assert bag(got.drop("kept").collect()) == brute_repeats(rows, 60)
        return
    order = {r["doc_id"]: r["rid"] for r in repeats._rows(docs, "doc_id", "text").collect()}
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: order[r[0]]):
        later = []
        for x in range(len(t) - 59):
            if t[x : x + 60] in seen:
                later.append((x, x + 60))
            seen.add(t[x : x + 60])
        want[i] = sum(b - a for a, b in repeats.merged(later))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == want


def test_texts_that_a_polynomial_confuses(spark, tmp_path):
    """Two texts of Thue-Morse signs around one middle: equal under any polynomial modulo 2^64, no 400 bytes in common."""
    signs = [bin(k).count("1") % 2 for k in range(256)]
    one, other = "".join("/;"[b] for b in signs), "".join(";/"[b] for b in signs)
    rows = []
    for seed in range(80):
        middle = "".join(map(chr, np.random.default_rng(seed).integers(97, 123, 128)))
        rows += [(2 * seed, one + middle + other), (2 * seed + 1, other + middle + one)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(f"file://{tmp_path}/d")
    assert bag(repeats.without_repeats(spark.read.parquet(f"file://{tmp_path}/d")).drop("kept").collect()) == brute_repeats(rows, 400)


def test_first_copies_stay(spark, tmp_path):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = text(300)
    rows = [(i, text(200) + passage + text(150)) for i in range(4)] + [(9, passage + passage)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    out = {r["doc_id"]: r for r in repeats.without_repeats(docs, 100, 40, keep="first").collect()}
    seen = set()
    for i, t in rows:
        later = []
        for x in range(len(t) - 99):
            if t[x : x + 100] in seen:
                later.append((x, x + 100))
            seen.add(t[x : x + 100])
        assert out[i]["n_removed"] == sum(b - a for a, b in repeats.merged(later))
    assert sum(bytes(r["kept"]).count(passage.encode()) for r in out.values()) == 1


def test_longest_factors():
    rng = np.random.default_rng(4)
    for _ in range(20):
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(20, 120))).astype(np.uint8)
        depth = 16
        starts = np.arange(len(data) - depth + 1)
        before, after = repeats.longest_factors(repeats.Suffixes(data, depth), starts)
        b = data.tobytes()
        common = lambda i, j: next((k for k in range(depth) if b[i + k] != b[j + k]), depth)
        assert before.tolist() == [max((common(i, j) for j in starts if j < i), default=0) for i in starts]
        assert after.tolist() == [max((common(i, j) for j in starts if j > i), default=0) for i in starts]


# 8


def brute_vectors(rows):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.asarray(v, float)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    names = [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return bag((r[0], links[i], names[i], r[0] == names[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [7, 8192])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "TILE", 5 if block == 7 else 1024)
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist(), g % 2) for k in range(8)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(100 + k, v, 0) for k, v in enumerate(bad)]
    rows += [(200, rows[0][1], 0), (200, rows[0][1], 0), (None, rows[0][1], 0), (201, rows[0][1], None), (202, [3.0 * x for x in rows[0][1]], 0), (203, rows[0][1][:8], 0), (204, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, copies int")
    assert bag(near_vectors.near_vectors(df.repartition(3)).collect()) == brute_vectors(rows)


def test_recall_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * side
    p = near_vectors.lines(64)
    found = sum(len(near_vectors.near_pairs(x[i : i + 1], y[i : i + 1], x[i : i + 1] @ p, y[i : i + 1] @ p, 0.93)[0]) for i in range(len(x)))
    assert found >= 0.99 * len(x)


# 9 and 10


def made_of(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def labelled(n=400):
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, rng.integers(97, 110, rng.integers(2, 9))))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(int(rng.integers(15, 120)))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[5] = w[9] = "scoundrel"
        if not good:
            w = [x + "$$$" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.mark.parametrize(("operator", "column", "divisor", "rest"), [(toxicity.toxicity, 2, 4, 2), (quality.quality, 1, 5, 0)])
def test_classifiers(spark, corpus, operator, column, divisor, rest):
    docs, labels = labelled()
    made = {r["doc_id"]: r for r in operator(*made_of(spark, [*docs, (None, "x"), (900, None), (901, ""), (902, "word " * 50000)], [*labels, (0, None, None), (None, 1, 1), (902, None, None)])).collect()}
    truth = {r[0]: r[column] for r in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % divisor == rest]
    assert all(made[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([made[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in made.values())
    assert {None, 900, 901, 902} <= set(made)
    # held-out labels change nothing
    flipped = [(i, 1 - q, 1 - t) if i in held else (i, q, t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in operator(*made_of(spark, docs, flipped)).collect()}
    assert all(again[i] == pytest.approx(made[i]["score"], abs=1e-9) for i, _ in docs)
    none = operator(corpus, corpus.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))).collect()
    assert len(none) == corpus.count() and {r["score"] for r in none} == {0.5}


def awkward_labelled(spark):
    """Repeated, null and empty rows, repeated and null labels, and columns with names that the operators use."""
    docs, labels = labelled(160)
    docs += [docs[3], docs[4], (5, "another text of five"), (None, "no id $$$"), (900, None), (901, ""), (902, "word " * 3000)]
    labels += [labels[3], labels[8], (None, 1, 1), (900, 0, 0), (901, None, None), (999, 1, 0)]
    d, y = made_of(spark, docs, labels)
    d = d.select(F.lit(7).alias("score"), "doc_id", F.lit("x").alias("features"), F.lit(0).alias("toxic"), "text", F.lit(1).alias("quality"), F.lit(2.0).alias("length"), F.lit(3).alias("label"))
    return docs, labels, d, y.select("quality", F.lit("t").alias("text"), "toxic", "doc_id", F.lit(1).alias("length"), F.lit(1).alias("n"))


def training_rows(docs, labels, column, divisor, rest):
    """(text, label) of every document and label row with one id that labels are learned from."""
    known = [(y[0], y[column]) for y in labels if y[0] is not None and y[column] in (0, 1) and zlib.crc32(str(y[0]).encode()) % divisor != rest]
    return [(t, y) for i, y in known for j, t in docs if i == j], Counter(y for _, y in known)


def brute_ngrams(text):
    """The set of hashed n-grams, one n-gram at a time."""
    data, low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").encode(), 2**32 - 1
    found = set()
    for n in toxicity.SIZES:
        for i in range(len(data) - n + 1):
            h = (sum(b * pow(0x9E3779B1, k, 2**32) for k, b in enumerate(data[i : i + n])) & low) ^ n
            h = h * 0x85EBCA6B & low
            found.add(((h ^ h >> 15) * 0x9E3779B1 & low) >> 32 - toxicity.BITS)
    return found


def test_toxicity_against_dense_matrices(spark):
    docs, labels, d, y = awkward_labelled(spark)
    train, shares = training_rows(docs, labels, 2, 4, 2)
    sets, toxic = [brute_ngrams(t) for t, _ in train], np.array([bool(v) for _, v in train])
    names = sorted(set().union(*sets))
    seen = np.array([[name in s for name in names] for s in sets], float)
    a, b = toxic.sum(), (~toxic).sum()
    p, q = (seen[toxic].sum(axis=0) + 1) / (a + 2), (seen[~toxic].sum(axis=0) + 1) / (b + 2)
    used = abs(p - q) >= toxicity.SIGNIFICANT * np.sqrt(p * (1 - p) / a + q * (1 - q) / b)
    ratio = np.log(p / q)
    x = np.column_stack([(seen * ratio)[:, used], np.ones(len(train))])
    share = np.where(toxic, 0.5 / a, 0.5 / b)
    w, m, v = np.zeros(x.shape[1]), 0, 0
    small = np.array([1e-6] * used.sum() + [1e-8])
    for k in range(1, toxicity.STEPS + 1):
        slope = x.T @ ((1 / (1 + np.exp(-x @ w)) - toxic) * share) + toxicity.PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= toxicity.RATE * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + small)
    weight = {name: r * c for name, r, c in zip(np.array(names)[used], ratio[used], w, strict=False)}
    bias = w[-1] + toxicity.PRIOR * np.log(shares[1] / shares[0])
    want = [(i, 1 / (1 + np.exp(-bias - sum(weight.get(g, 0) for g in brute_ngrams(t))))) for i, t in docs]
    got = [(r["doc_id"], r["score"]) for r in toxicity.toxicity(d, y).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [r[0] for r in sorted(got, key=order)] == [r[0] for r in sorted(want, key=order)]
    assert [r[1] for r in sorted(got, key=order)] == pytest.approx([r[1] for r in sorted(want, key=order)], abs=1e-4)
    assert used.sum() > 5 and len({round(s, 3) for _, s in got}) > 5


def test_toxicity_of_long_texts_in_chunks(monkeypatch):
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 6, 60, 63, 64, 65, 200):
        text = "".join(map(chr, rng.integers(97, 123, n)))
        whole = toxicity.presence(text)
        weights = rng.standard_normal(1 << toxicity.BITS).astype(np.float32)
        score = toxicity.score_texts([text, "abc", text], weights, 0.1)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "CHUNK", 7)
            assert (toxicity.presence(text) == whole).all()
            assert (toxicity.score_texts([text, "abc", text], weights, 0.1) == score).all()
        assert score[0] == score[2]


def brute_statistics(text):
    words = (text or "").split()
    if not words:
        return [0.0] * 11
    n, lines = len(words), [x for x in text.split("\n") if x]
    count = lambda kind: sum(len(re.findall(kind, c)) for c in text)
    capitals, small = count("[A-Z]"), sum(1 if c.isascii() else len(c.encode()) for c in text if "a" <= c <= "z" or not c.isascii())
    most = max(words.count(w) for w in set(words))
    return [
        np.log(1 + n), np.log(len(text) / n), (count(r"[#$%&*+/<=>@\\^_`|~!{}\[\]]") / n) ** 0.5, (capitals / (capitals + small + 1)) ** 0.5, (count("[0-9]") / n) ** 0.5, (count("[.,;:?]") / n) ** 0.5,
        (len(lines) / n) ** 0.5, np.log(1 + n / len(set(words))) / np.log(1 + np.log(1 + n)), (sum(a == b for a, b in zip(words, words[1:], strict=False)) / n) ** 0.5, (most / n) ** 0.5, (1 - len(set(lines)) / len(lines)) ** 0.5 if lines else 0.0,
    ]


def test_quality_against_plain_densities(spark):
    docs, labels, d, y = awkward_labelled(spark)
    docs += [(903, "Ünï x\nA#b {1}\nA#b {1}\n\n7,8;9"), (904, "\n \n"), (905, "GO go GO")]
    d = d.unionByName(spark.createDataFrame(docs[-3:], "doc_id bigint, text string"), allowMissingColumns=True)
    train, _ = training_rows(docs, labels, 1, 5, 0)
    table, good = np.array([brute_statistics(t) for t, _ in train]), np.array([v for _, v in train])
    scale = np.maximum(table.std(axis=0), 1e-9**0.5)
    z = (table - table.mean(axis=0)) / scale
    covs = {v: np.cov(z[good == v].T, bias=True) for v in (0, 1)}
    pooled = sum(covs[v] * (good == v).mean() for v in (0, 1))

    def density(x, v):
        cov = (1 - quality.POOLED) * covs[v] + quality.POOLED * pooled
        cov = np.where(np.eye(11) > 0, cov + quality.FLOOR * np.eye(11), (1 - quality.DIAGONAL) * cov)
        off = x - z[good == v].mean(axis=0)
        return np.log((good == v).mean()) - 0.5 * (np.linalg.slogdet(cov)[1] + off @ np.linalg.solve(cov, off))

    want = []
    for i, t in docs:
        x = (np.array(brute_statistics(t)) - table.mean(axis=0)) / scale
        margin = density(x, 1) - density(x, 0)
        odds = (1 + abs(margin)) ** np.sign(margin)
        want.append((i, odds / (1 + odds)))
    got = [(r["doc_id"], r["score"]) for r in quality.quality(d, y).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [r[0] for r in sorted(got, key=order)] == [r[0] for r in sorted(want, key=order)]
    assert [r[1] for r in sorted(got, key=order)] == pytest.approx([r[1] for r in sorted(want, key=order)], abs=1e-6)
    kept = quality.drop_rejected(d.select("doc_id", "text", "length"), y)
    assert kept.columns == ["doc_id", "text", "length"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, s in want if s >= 0.3)


def test_commonest_word_wherever_it_stands():
    at = quality.NAMES.index("commonest")
    some = ["buy"] * 30 + [f"w{i}" for i in range(20)] + ["buy"] + [f"v{i}" for i in range(50)]
    for seed in range(5):
        assert quality.statistics(" ".join(some))[at] == pytest.approx((31 / 101) ** 0.5)
        random.Random(seed).shuffle(some)


def test_rejected_documents_go(spark, tmp_path):
    docs, labels = labelled()
    d, y = made_of(spark, docs, labels)
    d.withColumn("score", F.lit("kept")).write.parquet(f"file://{tmp_path}/d")
    left = quality.drop_rejected(spark.read.parquet(f"file://{tmp_path}/d"), y)
    assert left.columns == ["doc_id", "text", "score"]
    good = {i for i, q, _ in labels if q}
    kept = {r["doc_id"] for r in left.collect()}
    assert len(kept & good) > 0.97 * len(good) and len(kept - good) < 0.05 * len(labels)


# all


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    made = [
        jaccard.jaccard_components(nothing), jaccard.keep_one_per_component(nothing), secrets.secret_digests(nothing), mixing.sampled(nothing), mixing.mix(nothing), packing.pack(nothing), licenses.license_scan(nothing),
        exact_dedup.exact_duplicates(nothing), exact_dedup.drop_exact_duplicates(nothing), repeats.without_repeats(nothing), near_vectors.near_vectors(vectors), toxicity.toxicity(nothing, labels), quality.quality(nothing, labels), quality.drop_rejected(nothing, labels),
    ]
    assert [df.count() for df in made] == [0] * len(made)
