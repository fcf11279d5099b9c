"""The training-data operators against brute force, on rows with nulls, empty texts, copies and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from peptrail.llm import scratch, textscan
from peptrail.llm.embedding_dedup import near_vectors
from peptrail.llm.fingerprints import canonical, digest, edit_stability, fingerprints
from peptrail.llm.license_scan import TEMPLATES, scan_licenses
from peptrail.llm.mixing import mix_sources, mixed
from peptrail.llm.near_dedup import near_duplicates
from peptrail.llm.packing import boundaries, pack, padded_batches, tokenized
from peptrail.llm.quality import classify
from peptrail.llm.substring_dedup import substring_dedup
from peptrail.llm.token_output import read_tokens, sequence_at, write_tokens
from peptrail.llm.warc import read_warc, write_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, hash string, bucket string, perplexity string, row string"
draw = random.Random(7)
VOCABULARY = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(draw.choices(VOCABULARY, k=n))


def corpus():
    passage, base = prose(70), prose(200).split()
    texts = [None, "", "one", " \t\n", prose(30), prose(49), prose(50)]
    texts += [prose(40) + " " + passage + "\n" + prose(20), passage, "x " + passage + " y " + passage, prose(900)]
    for _ in range(6):  # near copies
        words = list(base)
        words[draw.randrange(200)] = "changed"
        texts.append(" ".join(words))
    texts += [texts[10], texts[8], texts[10], "Größe  ﬁne ÉCOLE", "grösse fine école", "the <|endoftext|> mark"]
    texts += [prose(draw.randrange(5, 120)) for _ in range(20)]
    return [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][i % 4], len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def words(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]


def test_windows_do_not_depend_on_blocks(monkeypatch, rows):
    import pyarrow as pa

    texts = pa.array([r[1] for r in rows], pa.string())
    whole = np.concatenate([b.hashes() for b in textscan.blocks(texts)])
    assert (whole == np.concatenate([b.hashes() for b in textscan.blocks(texts, 100)])).all()
    assert len(whole) == sum(len(words(r[1])) for r in rows)


def test_substring_dedup(spark, docs, rows):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for r in substring_dedup(spark, docs).collect():
        w = words(rows[r.doc_id][1])
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r.doc_id for k in range(50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_license_scan(spark, rows):
    planted = {i: (name, prose(30) + " " + text + " " + prose(30)) for i, (name, text) in enumerate(sorted(TEMPLATES.items()))}
    df = spark.createDataFrame([(i, t) for i, (_, t) in planted.items()] + [(100, None), (101, ""), (102, prose(300)), (103, "few words only")], "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in scan_licenses(spark, df).collect():
        found[r.doc_id].add(r.license)
    assert all(name in found[i] for i, (name, _) in planted.items())
    assert not any(i >= 100 for i in found)


def license_shingles(text):
    tokens = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", text or "")]
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}


def test_license_scan_against_brute_force(spark):
    """Every template whole, at every offset of the stride, and damaged around the threshold; null and repeated ids."""
    texts = []
    for template in TEMPLATES.values():
        tokens = template.split()
        for before in (0, 1, 2, 3, 40):
            texts.append(" ".join([prose(before), template, prose(20)]))
        for k in range(12):
            broken = list(tokens)
            for at in draw.sample(range(len(broken)), 1 + k % 3):
                broken[at] = "other"
            texts.append(" ".join([prose(k), *broken, prose(9)]))
        for k in (1, 2, 3, 5, 8):  # cut at an end
            texts.append(" ".join([prose(7), *tokens[k:], prose(9)]))
            texts.append(" ".join([prose(7), *tokens[:-k], prose(9)]))
    known = {name: license_shingles(t) for name, t in TEMPLATES.items()}
    ids = [None if i % 3 == 0 else i // 5 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, sh string, license string")
    expected = {}
    for i, t in zip(ids, texts, strict=True):
        own = license_shingles(t)
        for name, sh in known.items():
            if len(own & sh) >= 0.8 * len(sh):
                expected[i, t, name] = len(own & sh) / len(sh)
    keys = {r.k: r.text for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    for rows in (df, df.union(df)):  # equal rows are one document
        got = [((r.doc_id, keys[r.text_key], r.license), r.containment) for r in scan_licenses(spark, rows).collect()]
        assert len(got) == len(dict(got)) and dict(got).keys() == expected.keys()
        assert all(abs(v - expected[k]) < 1e-12 for k, v in got)


def test_license_scan_of_other_templates(spark):
    found = scan_licenses(spark, spark.createDataFrame([(1, "we say that all of this is ours alone now")], "doc_id long, text string"), texts=spark.createDataFrame([("own", "all of this is ours"), ("none", "too short")], "license string, text string"))
    assert [(r.doc_id, r.license, r.containment, r.passages) for r in found.collect()] == [(1, "own", 1.0, 1)]


def test_license_scan_of_long_templates(spark, monkeypatch):
    """A template of 5,000 words in long texts, broadcast and shuffled: same rows, shuffled bytes in proportion to text."""
    long = prose(5000)
    words_ = long.split()
    broken = " ".join(w if i % 100 else "other" for i, w in enumerate(words_))  # 95 % of its shingles
    texts = [prose(3000) + " " + long + " " + prose(3000), broken, " ".join(words_[:3900]), " ".join(words_[500:]), long + " " + prose(20_000) + " " + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([("long", long), ("five", "all of this is ours")], "license string, text string")
    answers = []
    for limit in (50_000, 0):
        monkeypatch.setattr("peptrail.llm.license_scan.BROADCAST_SHINGLES", limit)
        answers.append(sorted((r.doc_id, r.license, round(r.containment, 9)) for r in scan_licenses(spark, docs, texts=known).collect()))
    sh = license_shingles(long)
    want = [(i, "long", round(len(license_shingles(t) & sh) / len(sh), 9)) for i, t in enumerate(texts) if len(license_shingles(t) & sh) >= 0.8 * len(sh)]
    assert answers[0] == answers[1] == want and [x[0] for x in want] == [0, 1, 3, 4]
    plan = scan_licenses(spark, docs, texts=known)._jdf.queryExecution().toString()
    assert not any("array" in x and "Exchange" in x for x in plan.splitlines())


def test_embedding_dedup(spark):
    random_ = np.random.default_rng(3)
    centers = random_.normal(size=(6, 8))
    v = [(i, (centers[i % 6] + random_.normal(size=8) * random_.choice([0.05, 0.15])).tolist(), i % 2) for i in range(120)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [math.nan] + [1.0] * 7, 1), (203, v[0][1], None), (204, v[0][1], 0), (205, [None] + [1.0] * 7, 1), (206, [1.0, 2.0], 1), (207, [math.inf] + [1.0] * 7, 0)]
    df = spark.createDataFrame([(i, e, x, "z", "z") for i, e, x in v + odd], "vec_id long, embedding array<double>, label int, vec string, dim string")
    fine = [(i, np.array(e), x) for i, e, x in v + [odd[4]]]
    links = collections.defaultdict(set)
    for i, a, x in fine:
        for j, b, y in fine:
            if i != j and x == y and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j)
    assert links
    least = {i: i for i, *_ in v + odd}
    for _ in least:
        least = {i: min([c, *(least[j] for j in links[i])]) for i, c in least.items()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, df).collect()}
    assert got == {i: (len(links[i]), c, i == c) for i, c in least.items()}


def test_embedding_levels(spark):
    """Nodes of 16 points: several levels, dense clusters, copies, repeated and null ids."""
    random_ = np.random.default_rng(5)
    centers = random_.normal(size=(9, 6))
    scale = [0.001, 0.03, 0.2]
    v = [(i, (centers[i % 9] + random_.normal(size=6) * scale[i % 3]).tolist(), i % 8 == 0) for i in range(600)]
    v += [(1000 + i, v[1][1], v[1][2]) for i in range(120)] + [(5, v[40][1], v[40][2]), (None, v[2][1], v[2][2]), (None, v[44][1], v[44][2]), (5, [9.0] * 6, False)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label boolean").repartition(3)
    a = np.array([x for _, x, _ in v])
    a /= np.linalg.norm(a, axis=1)[:, None]
    label = np.array([x for *_, x in v])
    linked = (a @ a.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    ids = np.array([2**63 - 1 if i is None else i for i, *_ in v])
    least = ids.copy()
    while True:
        after = np.array([min(least[n], least[linked[n]].min(initial=least[n])) for n in range(len(v))])
        if (after == least).all():
            break
        least = after
    named = lambda i: None if i == 2**63 - 1 else int(i)
    expected = sorted(repr((named(i), int(n), named(c), bool(i == c))) for i, n, c in zip(ids, linked.sum(axis=1), least, strict=True))
    for part in (16, 2048):
        assert sorted(repr(tuple(r)) for r in near_vectors(spark, df, part=part).collect()) == expected


def test_fingerprints(spark, docs, rows):
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in edit_stability(spark, docs).collect()}
    assert len(got) == len(rows)
    for r, following in zip(order, [*order[1:], order[0]], strict=True):
        a, b = r[1] or "", following[1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_next == float(canonical(a) == canonical(b)) and g.near_edited == float(canonical(a) == canonical(edited))
        assert g.fingerprint.isalnum() and g.edited_fingerprint.isalnum()
    copies = {r.doc_id: r.first for r in fingerprints(spark, docs).collect()}
    plain = [canonical(r[1]) for r in rows]
    assert copies == {i: plain.index(p) for i, p in enumerate(plain)}


@pytest.mark.parametrize("width", [1, 2])
def test_fingerprints_of_crowded_buckets(spark, docs, rows, width):
    """Sixteen, or 256, hashes for all texts: every bucket holds several, of documents and edited ones."""
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in edit_stability(spark, docs, width).collect()}
    names, plains = collections.defaultdict(set), collections.defaultdict(set)
    for r, following in zip(order, [*order[1:], order[0]], strict=True):
        a, b = r[1] or "", following[1] or ""
        half, g = len(a) // 2, got[r[0]]
        edited = a[: len(a) - half] + b[:half]
        for text, name in ((a, g.fingerprint), (edited, g.edited_fingerprint)):
            names[canonical(text)].add(name)
            plains[name].add(canonical(text))
            assert name.split("-")[0] == digest(canonical(text), width)[0]
        assert g.near_next == float(canonical(a) == canonical(b)) and g.near_edited == float(canonical(a) == canonical(edited))
    assert all(len(x) == 1 for x in [*names.values(), *plains.values()]) and any("-2" in x for x in plains)
    plain = [canonical(r[1]) for r in rows]
    found = fingerprints(spark, docs, width).collect()
    assert {r.doc_id: (r.first, r.copies) for r in found} == {i: (plain.index(p), plain.count(p)) for i, p in enumerate(plain)}


def test_packing(spark, docs, rows):
    lengths, counts = np.array([3, 5, 8, 13, 40]), np.array([4, 1, 9, 2, 3])

    def cost(cuts):
        return sum(n * (min(c for c in cuts if c >= x) - x) for x, n in zip(lengths, counts, strict=True))

    import itertools

    for k in (1, 2, 3, 5):
        assert cost(boundaries(lengths, counts, k)) == min(cost([*c, 40]) for c in itertools.combinations(lengths[:-1].tolist(), k - 1))
    got = pack(spark, docs, buckets=4, budget=300).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens == len(words(rows[r.doc_id][1])) and (r.bucket == 0) == (r.n_tokens == 0)
        if r.bucket:
            assert r.padding == r.bucket_len - r.n_tokens >= 0
            batches[r.batch].append(r)
    for batch in batches.values():
        assert len({r.bucket_len for r in batch}) == 1 and sorted(r.slot for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0].bucket_len <= 300


def test_padding_of_long_documents_is_bounded(spark):
    """Lengths above 511 are rounded in the histogram: at most 1/256 of the best boundaries' cost is lost."""
    lengths = [draw.randrange(1, 4000) for _ in range(300)] + [3000] * 40
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n int").withColumn("text", F.lit(None).cast("string"))
    got = pack(spark, rows, buckets=5, length=F.col("n")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == dict(enumerate(lengths))

    def padding(values, cuts):
        return sum(min(c for c in cuts if c >= x) - x for x in values)

    raised = [n if n < 512 else math.ceil(n / 256 + n) for n in lengths]
    counts = collections.Counter(raised)
    cuts = boundaries(np.array(sorted(counts), dtype=float), np.array([counts[x] for x in sorted(counts)]), 5)
    assert sum(r.padding for r in got) == padding(lengths, {r.bucket_len for r in got}) <= sum(min(c for c in cuts if c >= y) - x for x, y in zip(lengths, raised, strict=True))


def test_padded_batches(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, long = Tokenizer.from_file(path), prose(30_000)
    more = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(None, "a b", "x"), (4, "again", "x"), (900, long, "x")], "doc_id long, text string, key string"))
    want = sorted(((i, [*encoder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in [*((r[0], r[1]) for r in rows), (None, "a b"), (4, "again"), (900, long)]), key=repr)
    tokens = tokenized(spark, more, path)
    assert sorted(((r.doc_id, list(r.ids)) for r in tokens.collect()), key=repr) == want
    placed = {(r.batch, r.slot): r for r in pack(spark, tokens, buckets=4, budget=300, shard=8, length=F.size("ids")).collect()}
    found = []
    for b in padded_batches(tokens, buckets=4, budget=300, shard=8, pad=7).collect():
        assert len(b.ids) == 1 or len(b.ids) * b.bucket_len <= 300
        for slot, (doc_id, ids, mask) in enumerate(zip(b.doc_ids, b.ids, b.mask, strict=True)):
            n = sum(mask)
            assert len(ids) == len(mask) == b.bucket_len and mask == [True] * n + [False] * (b.bucket_len - n) and set(ids[n:]) <= {7}
            p = placed.pop((b.batch, slot))
            assert (p.doc_id, p.n_tokens, p.bucket_len) == (doc_id, n, b.bucket_len)
            found.append((doc_id, ids[:n]))
    assert not placed and sorted(found, key=repr) == want
    assert padded_batches(tokenized(spark, docs.where("false"), path)).count() == 0


def near_pairs(texts):
    """The pairs of texts with a weighted Jaccard similarity of 0.8 or more, TF-IDF over distinct texts."""
    shingles = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else collections.Counter() for t in texts]
    df = collections.Counter(s for x in dict(zip(texts, shingles, strict=True)).values() for s in x)
    n = len({t or "" for t in texts})
    idf = {s: 1 + math.log((1 + n) / (1 + k)) for s, k in df.items()}
    weigh = lambda c: sum(k * idf[s] for s, k in c.items())
    return [(i, j) for i in range(len(texts)) for j in range(i) if shingles[i] and shingles[j] and weigh(shingles[i] & shingles[j]) >= 0.8 * weigh(shingles[i] | shingles[j])]


def least_ids(n, pairs):
    least = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_near_dedup(spark, docs, rows):
    got = {r.doc_id: r.class_id for r in near_duplicates(spark, docs).collect()}
    near = near_pairs([r[1] for r in rows])
    assert near and [got[i] for i in range(len(rows))] == least_ids(len(rows), near)


def test_near_dedup_of_a_group_of_edited_copies(spark):
    """Copies around the threshold, that resemble each other less than their original, with and without it."""
    texts = []
    for with_original in (True, False):
        base = prose(400).split()
        texts += [" ".join(base)] * with_original
        for k in range(45):
            edit = list(base)
            for at in draw.sample(range(400), 1 + k % 6):
                edit[at] = f"edit{draw.randrange(10_000)}"
            texts.append(" ".join(edit))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = near_pairs(texts)
    assert len(near) > 60 and [got[i] for i in range(len(texts))] == least_ids(len(texts), near)


def test_token_files(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    files = write_tokens(spark, docs, scratch.new_path(spark, "t"), path, sequence=16)
    got = {r.doc_id: r for r in read_tokens(files).collect()}
    encoder, start, stream = Tokenizer.from_file(path), 0, []
    for d, t, *_ in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
        stream += ids
    first = files.orderBy("start").first()
    ids, mask = sequence_at(first.file, 1)
    assert ids.tolist() == stream[16:32] and mask.all()


def test_warc(spark):
    html = ["a" * 99, "b" * 100, None, "", "é" * 60, "<p>" + prose(50)]
    pages = [(i, f"http://x/{i} {i}", html[i % 6]) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("z")).repartition(3)
    for r in read_warc(write_warc(spark, df, scratch.new_path(spark, "w"))).collect():
        payload = (html[r.page_id % 6] or "").encode()
        first = min(i for i, _, h in pages if (h or "").encode() == payload)
        revisit = len(payload) >= 100 and first != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_mixing(spark, docs, rows):
    got = {r.doc_id: r for r in mix_sources(spark, docs).collect()}
    assert got == {r.doc_id: r for r in mix_sources(spark, docs.repartition(5)).collect()}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = ["a", "b", "c", None]
    weight, total, cut = dict(zip(names, [5, 2, 1, 5], strict=True)), 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in cut]
        level = (total - sum(cut.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        cut |= {s: 2.0 * sizes[s] for s in over}
    for s in names:
        target = cut.get(s, level * weight[s])
        mine = [r for r in got.values() if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[s] and r.size == len(words(rows[r.doc_id][1])) and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine) / 2 + 1
    copies = collections.Counter(r.doc_id for r in mixed(spark, docs).collect())
    assert copies == collections.Counter({d: r.times for d, r in got.items() if r.times})


def test_repeated_rows_and_empty_tables(spark, docs, rows):
    twice = docs.where("doc_id in (1, 6, 8, 10)").union(docs.where("doc_id in (6, 10)")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    empty = docs.where("false")
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    runs = [
        lambda d: substring_dedup(spark, d),
        lambda d: classify(spark, d, labels),
        lambda d: edit_stability(spark, d),
        lambda d: pack(spark, d),
        lambda d: near_duplicates(spark, d),
        lambda d: mix_sources(spark, d),
        lambda d: read_tokens(write_tokens(spark, d, scratch.new_path(spark, "t"), path)),
    ]
    for run in runs:
        assert run(twice).count() == 7
        assert run(empty).count() == 0
    assert scan_licenses(spark, empty).count() == 0
    assert classify(spark, twice, labels.where("false")).where("kept").count() == 7
    assert near_vectors(spark, vectors).count() == 0
    assert read_warc(write_warc(spark, pages, scratch.new_path(spark, "w"))).count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "passages", "mixing", "packing"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.save(spark, stage(spark, now, str(tmp_path)), name)
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    ids = lambda name: [r.doc_id for r in seen[name]]
    kept = {r.doc_id for r in near_duplicates(spark, spark.createDataFrame(seen["quality"], SCHEMA)).where("kept").collect()}
    assert sorted(ids("near_dedup")) == sorted(kept) and {8, 10} <= kept | {8, 10}
    cut = {r.doc_id: r for r in substring_dedup(spark, spark.createDataFrame(seen["near_dedup"], SCHEMA)).collect()}
    assert sorted(ids("passages")) == sorted(kept)
    for r in seen["passages"]:
        if cut[r.doc_id].n_removed:
            assert r.text == cut[r.doc_id].kept_text and r.n_chars == len(r.text)
        else:
            assert r.text == rows[r.doc_id][1]
    assert sorted(ids("packing")) == sorted(ids("mixing"))
