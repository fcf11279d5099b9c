"""Fixed vectors of annotation packing, taxonomy and search, a random model, files and requests."""

import json
import os
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from peptrail.functions import annotations
from peptrail.operators import array_search, index, prefixes, search, settle, stored
from peptrail.operators import taxonomy as taxonomy_
from peptrail.operators.taxonomy import lineage, lowest_common_ancestor
from peptrail.plans import sql
from peptrail.plans.engine import PeptideEngine, document, write_json, write_text
from peptrail.sources import files
from peptrail.streaming import requests as requests_module
from peptrail.streaming.requests import answer_batch, answer_stream, hit_stream, read_requests

real_meeting = stored.Ordered.meeting
# A small taxonomy and packed forms of annotations.
TAXA = [(1, "root", "no rank", 1, True), (2, "Bacteria", "superkingdom", 1, True), (6, "Azorhizobium", "genus", 1, True), (7, "A. caulinodans", "species", 6, True), (9, "Buchnera aphidicola", "species", 6, True), (10, "Cellvibrio", "genus", 6, True), (11, "Cellulomonas gilvus", "species", 10, True), (13, "Dictyoglomus", "genus", 11, True), (14, "D. thermophilum", "species", 10, True), (16, "Methylophilus", "genus", 14, True), (17, "M. methylotrophus", "species", 16, True), (18, "Pelobacter", "genus", 17, True), (19, "Syntrophotalea carbinolica", "species", 17, True), (20, "Phenylobacterium", "genus", 19, True), (21, "Invalid", "species", 19, False)]
PACKED = [("", ""), ("EC:1.1.1.-", "2C2C2CBDD0"), ("GO:0009279", "D111A38AD0"), ("IPR:IPR016364", "DD127475"), ("IPR:IPR016364;GO:0009279;IPR:IPR008816", "D111A38AD127475E119927"), ("IPR:IPR016364;EC:1.1.1.-;EC:1.2.1.7", "2C2C2CBE2C3C2C8DD1274750"), ("EC:1.1.1.-;GO:0009279;GO:0009279", "2C2C2CBD111A38AE111A38AD"), ("IPR:IPR016364;EC:1.1.1.-;IPR:IPR032635;GO:0009279;IPR:IPR008816", "2C2C2CBD111A38AD127475E143746E119927")]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(TAXA, "id long, name string, rank string, parent long, valid boolean")


def database(spark, sequences, taxa=None):
    rows = [(i, f"P{i}", (taxa or {}).get(i, 7), s, "EC:1.1.1.-;GO:0009279") for i, s in enumerate(sequences)]
    return spark.createDataFrame(rows, "protein_idx long, uniprot_id string, taxon_id long, sequence string, fa string")


def asked(spark, *peptides):
    return spark.createDataFrame(list(enumerate(peptides)), "ord long, sequence string")


def test_packing(spark):
    df = spark.createDataFrame(PACKED + [(None, None)], "fa string, hex string").withColumn("packed", annotations.pack(F.col("fa")))
    for r in df.select("fa", "hex", F.hex("packed").alias("got"), annotations.unpack(F.col("packed")).alias("back")).collect():
        assert r.got == r.hex
        assert (r.back is None) == (r.fa is None)
        assert r.fa is None or sorted(r.back.split(";")) == sorted(r.fa.split(";"))
    with pytest.raises(Exception, match="cannot pack"):
        spark.createDataFrame([("EC:x",)], "fa string").select(annotations.pack(F.col("fa"))).collect()


def test_dictionary_codes(spark):
    names = [f"IPR:IPR00000{i}" for i in range(1, 5)] + ["GO:0000001", "GO:0000002", "GO:0000003", "EC:1.1.1.-", "EC:2.12.3.7", "EC:2.2.-.-"]
    names[0], names[2] = "IPR:IPR000001", "IPR:IPR000002"
    dictionary = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "code int, annotation string")
    rows = spark.createDataFrame([(1, "IPR:IPR000001;EC:1.1.1.-;GO:0000002;NO:1"), (2, ""), (3, None)], "k int, fa string")
    codes = annotations.encode_codes(rows, "k", "fa", dictionary)
    assert {r.k: bytes(r.codes) for r in codes.collect()} == {1: bytes([0, 0, 0, 7, 0, 0, 5, 0, 0]), 2: b"", 3: b""}
    assert {r.k: r.text for r in annotations.decode_codes(codes, "k", "codes", dictionary).collect()} == {1: "IPR:IPR000001;EC:1.1.1.-;GO:0000002", 2: "", 3: ""}


def test_common_ancestors(spark, taxonomy):
    groups = [{7, 9}, {11, 14}, {17, 19}, {9, 10}, {2, 6, 20}, {1, 7, 9}, {17}]
    rows = spark.createDataFrame([(g, t) for g, ts in enumerate(groups) for t in ts] + [(6, 17)], "g int, taxon_id long")
    paths = lineage(taxonomy).cache()
    plain, star = ({r.g: r.ancestor for r in lowest_common_ancestor(rows, paths, "g", star=x).collect()} for x in (False, True))
    assert [plain[i] for i in range(7)] == [6, 10, 17, 6, 1, 1, 17]
    assert [star[i] for i in range(7)] == [6, 10, 19, 6, 1, 6, 17]
    snapped = {r.id: r.snapped for r in paths.collect()}
    assert snapped[21] == 19 and all(snapped[t[0]] == t[0] for t in TAXA if t[0] != 21)
    with pytest.raises(Exception, match="no such parent"):
        lineage(taxonomy.where("id <> 6")).collect()


def test_ancestors_of_random_groups(spark, monkeypatch):
    """Groups of one taxon to all of them, chains among them, against paths compared one by one; joined either way."""
    draw = random.Random(5)
    parent = {1: 1}
    for i in range(2, 61):  # numbers that do not follow the tree, and one long chain
        parent[(i * 37) % 61 + 1] = draw.choice([*parent]) if i % 3 else [*parent][-1]
    rows = [(i, f"t{i}", draw.choice(["no rank", "genus"]), p, draw.random() < 0.7) for i, p in parent.items()]
    up = lambda t: up(parent[t]) + [t] if parent[t] != t else [t]
    paths = lineage(spark.createDataFrame(rows, "id long, name string, rank string, parent long, valid boolean"))
    snapped = {r.id: r.snapped for r in paths.collect()}
    groups = {g: draw.choices([*parent], k=draw.choice([1, 2, 3, 5, 200])) for g in range(80)} | {80: up(draw.choice([*parent])), 81: [*parent]}
    members = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in [*ts, 10_000]], "g int, taxon_id long")
    for star in (False, True):
        want = set()
        for g, ts in groups.items():
            left = {t for t in ts if not star or not any(t in up(x)[:-1] for x in ts)}
            ancestor = [a for a in up(min(left)) if all(a in up(t) for t in left)][-1]
            want.add((g, ancestor, snapped[ancestor]))
        for most in (100, 10):
            monkeypatch.setattr(taxonomy_, "BROADCAST_TAXA", most)
            assert {tuple(r) for r in lowest_common_ancestor(members, paths, "g", star=star).collect()} == want
    plan = lowest_common_ancestor(members, paths, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1  # a group is two numbers, at any depth


def test_suffix_order_of_long_repeats(spark):
    """Ties far beyond the letters that suffixes are first ordered by, in and across proteins."""
    sequences = ["AB" * 60, "K" * 150, "AB" * 70 + "C", "", "AB" * 60, "K" * 33, "AB" * 60]
    text = "-".join(sequences) + "$"
    prepared = index.prepare(database(spark, sequences))
    for k in (1, 5):
        got = [r.pos for r in index.suffix_array(prepared, k).orderBy("rank").collect()]
        assert got == sorted(range(0, len(text), k), key=lambda pos: text[pos:])


def test_suffix_order(spark):
    prepared = index.prepare(database(spark, ["AI", "BLACVAA", "AC", "KCRLZ"]))
    order = lambda k: [r.pos for r in index.suffix_array(prepared, k).orderBy("rank").collect()]
    assert order(1) == [19, 10, 2, 13, 9, 8, 11, 5, 0, 3, 12, 15, 6, 1, 4, 17, 14, 16, 7, 18]
    assert order(3) == [9, 0, 3, 12, 15, 6, 18]
    bounds = {r.pep: (r.lo, r.hi) for r in search.search_bounds(index.suffix_array(prepared), prepared, asked(spark, "A", "$", "AC", "I", "RIZ")).collect()}
    assert bounds == {"A": (4, 9), "$": (0, 1), "AC": (6, 8), "I": (13, 16), "RIZ": (17, 18)}
    at = index.protein_at(spark.range(11).withColumnRenamed("id", "pos"), index.prepare(database(spark, ["ACG", "CG", "AAA"])), block=2)
    assert [r.protein_idx for r in at.orderBy("pos").collect()] == [0, 0, 0, None, 1, 1, None, 2, 2, 2, None]


@pytest.mark.parametrize(("size", "fan"), [(1 << 18, 16), (7, 2)])
def test_prefix_intervals(spark, taxonomy, tmp_path, size, fan):
    """Every repeated prefix against a count of all prefixes, with repeats far beyond the first letters; folded in one range and in many."""
    draw = random.Random(9)
    sequences = ["".join(draw.choices("AILKC", k=draw.randrange(0, 12))) for _ in range(25)] + ["K" * 140, "IL" * 50 + "C", "LI" * 50, "IL" * 50, "", "A"]
    taxa = {i: draw.choice([7, 9, 11, 13, 19, 21, 999]) for i in range(len(sequences))}
    prepared, paths = index.prepare(database(spark, sequences, taxa)), lineage(taxonomy)
    text, up = "-".join(sequences).replace("L", "I") + "$", {r.id: r.path for r in paths.collect()}
    order = sorted(range(len(text)), key=lambda p: text[p:])
    owner = [i for i, s in enumerate(sequences) for _ in range(len(s) + 1)]
    ends = [re.search("[-$]", text[p:]).start() for p in range(len(text))]
    got = {r.rank: r.shared for r in prefixes.shared_letters(prepared).collect()}
    share = lambda p, q: len(os.path.commonprefix([text[p : p + ends[p]], text[q : q + ends[q]]]))
    assert got == {r: share(order[r - 1], p) if r else 0 for r, p in enumerate(order)}
    at = {}
    for rank, p in enumerate(order):
        for k in range(1, ends[p] + 1):
            at.setdefault(text[p : p + k], []).append(rank)
    longer = {x[:-1] for x in at if len(at[x]) == len(at.get(x[:-1], ""))}
    snapped = {r.id: r.snapped for r in paths.collect()}

    def lca(ranks):
        lines = [up[taxa[owner[order[r]]]] for r in ranks if taxa[owner[order[r]]] in up]
        common = os.path.commonprefix(lines)
        return snapped[common[-1]] if common else None

    want = {(len(x), ranks[0], len(ranks), lca(ranks)) for x, ranks in at.items() if len(ranks) > 1 and x not in longer}
    table = prefixes.prefix_intervals(prepared, paths, size, fan).cache()
    rows = table.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    if fan > 2:
        array_search.write_array(index.suffix_array(prepared), prepared, str(tmp_path / "sa"), 1, step=16)
        array = array_search.StoredArray(spark, str(tmp_path / "sa"), prepared)
        asked_ = [*draw.sample([*at], 40), "K" * 140, "ZZ"]
        bounds = array.bounds(spark.createDataFrame([(p.encode(),) for p in asked_], "pep_il binary"))
        answers = {bytes(r.pep_il).decode(): r.lca for r in prefixes.taxa_of_bounds(bounds, table, array, paths).collect()}
        assert answers == {p: lca(at[p]) for p in asked_ if p in at}


@pytest.mark.parametrize("sparseness", [1, 3])
def test_random_model(spark, taxonomy, sparseness):
    """Order, cutoff and repeated proteins, against a walk over the whole text."""
    draw = random.Random(sparseness)
    sequences = ["".join(draw.choices("AIL", k=draw.randrange(0, 7))) for _ in range(30)]
    sequences[5:9] = sequences[1:5]
    peptides = ["".join(draw.choices("AIL", k=draw.randrange(1, 5))) for _ in range(25)] + ["A-I", "-", "I--", "IL-A", "L-I-A", "il\n", "", "ZZ"]
    engine = PeptideEngine(database(spark, sequences, {3: 9, 4: 21}), taxonomy, sparseness)
    text = "-".join(sequences) + "$"
    owner = [i for i, s in enumerate(sequences) for _ in range(len(s) + 1)]
    folded = text.replace("L", "I")
    for cutoff, equalize in ((10_000, True), (4, False)):
        want = {}
        for ord_, raw in enumerate(peptides):
            pep = raw.removesuffix("\n").upper()
            same = (lambda x: x.replace("L", "I")) if equalize else (lambda x: x)
            hits = [p for p in range(len(text)) if pep and len(pep) >= sparseness and same(text[p : p + len(pep)]) == same(pep)]
            hits.sort(key=lambda p: (-p % sparseness, folded[p + -p % sparseness :]))
            if hits:
                cut = hits[: max(cutoff, 1)]
                want[ord_] = ([f"P{owner[p]}" for p in cut if text[p] not in "-$"], len(cut) >= cutoff)
        got = {r.ord: ([p.uniprot_accession for p in r.proteins], r.cutoff_used) for r in engine.search(asked(spark, *peptides), cutoff, equalize).collect()}
        assert got == want


def test_both_joins_agree(spark, monkeypatch):
    prepared = index.prepare(database(spark, ["BOLTANVIL", "WIDGET", "", "LLIL"]))
    wanted = spark.createDataFrame([(x,) for x in ("BOLT", "I", "WIDGET", "LI")], "pep string")
    rows = lambda df: sorted((r.pep, r.protein_idx, r.off) for r in df.select("pep", "protein_idx", "off").collect())
    near = rows(search.occurrences(prepared, wanted, True))
    monkeypatch.setattr(search, "BROADCAST_PEPTIDES", 0)
    assert rows(search.occurrences(prepared, wanted, True)) == near
    assert rows(search.indexed_occurrences(index.seed_index(prepared), prepared, wanted, True)) == near


def test_analysis(spark, taxonomy):
    engine = PeptideEngine(database(spark, ["AAC", "CAAC", "GG"], {0: 17, 1: 19, 2: 21}), taxonomy)
    rows = {r.sequence: r for r in engine.analyse(asked(spark, "aac", "A", "GG", "TT"), clean_taxa=True).collect()}
    assert set(rows) == {"aac", "A"}
    assert rows["aac"].lca == 19 and sorted(rows["A"].taxa) == [17, 17, 19, 19]
    assert rows["A"].fa.counts == {"all": 4, "EC": 2, "GO": 2, "IPR": 0} and rows["A"].fa.data == {"EC:1.1.1.-": 4, "GO:0009279": 4}
    cut = engine.analyse(asked(spark, "A", "GG"), cutoff=1, clean_taxa=True).orderBy("ord").collect()
    assert [(r.lca, len(r.taxa), r.cutoff_used) for r in cut] == [(1, 1, True), (1, 0, True)]
    assert {r.sequence: r.taxon for r in engine.taxon(asked(spark, "AAC", "TT")).collect()} == {"AAC": 17, "TT": None}
    assert [r.found for r in engine.exists(asked(spark, "GG", "TT", "")).orderBy("ord").collect()] == [True, False, True]
    assert json.loads(document(engine.search(asked(spark, "GG"))))["result"][0]["proteins"][0]["taxon"] == 21
    empty = PeptideEngine(database(spark, ["A"]).where("false"), taxonomy)
    assert empty.analyse(asked(spark, "A")).count() == 0


def test_files(spark, taxonomy, tmp_path):
    (tmp_path / "tax.tsv").write_bytes(b"".join(f"{i}\t{n}\t{r}\t{p}\t".encode() + (b"\x01   " if i == 1 else b"\x01" if v else b"\x00") + b"\n" for i, n, r, p, v in TAXA))
    read = files.read_taxonomy(spark, str(tmp_path / "tax.tsv"))
    assert sorted(map(tuple, read.collect())) == TAXA
    packed = bytes.fromhex(PACKED[4][1])
    (tmp_path / "p.tsv").write_bytes(b"P1\t7\tmlpg\t" + packed + b"\nP2\t999\tAA\t\nP3\t17\tKW\t\n")
    rows = files.read_proteins(spark, str(tmp_path / "p.tsv"), read).orderBy("line").collect()
    assert [(r.line, r.uniprot_id, r.taxon_id, r.sequence, r.fa) for r in rows] == [(0, "P1", 7, "MLPG", "GO:0009279;IPR:IPR016364;IPR:IPR008816"), (2, "P3", 17, "KW", "")]
    engine = PeptideEngine.load(files.read_proteins(spark, str(tmp_path / "p.tsv"), read), read, "line")
    assert engine.search(asked(spark, "KW")).first().proteins[0].uniprot_accession == "P3"
    (tmp_path / "bad.tsv").write_text("P1\t7\n")
    with pytest.raises(Exception, match="expected 3 fields"):
        files.read_plain_proteins(spark, str(tmp_path / "bad.tsv"), read).collect()
    (tmp_path / "pep.txt").write_text("AAC\n\nGG\n")
    assert [(r.ord, r.sequence) for r in files.read_peptides(spark, str(tmp_path / "pep.txt")).orderBy("ord").collect()] == [(0, "AAC"), (1, ""), (2, "GG")]


def test_suffix_array_file(spark, tmp_path):
    values = [5, 2165487362, -12315135] + list(range(40))
    array = spark.createDataFrame(list(enumerate(values)), "rank long, pos long")
    files.write_suffix_array(array, str(tmp_path / "sa.bin"), 3, joined=True)
    assert (tmp_path / "sa.bin").read_bytes()[:9] == b"\x03" + (5).to_bytes(8, "little") and [p.name for p in tmp_path.iterdir()] == ["sa.bin"]
    assert [(r.sparseness, r.pos) for r in files.read_suffix_array(spark, str(tmp_path / "sa.bin")).orderBy("rank").collect()] == [(3, v) for v in values]


def test_suffix_array_parts(spark, tmp_path):
    values = [5, 2165487362, -12315135] + list(range(40))
    array = spark.createDataFrame(list(enumerate(values)), "rank long, pos long")
    files.write_suffix_array(array, str(tmp_path / "sa"), 3, joined=False)
    parts = sorted((tmp_path / "sa").iterdir())
    assert len(parts) > 1 and all(p.read_bytes()[0] == 3 for p in parts)
    rows = spark.read.format("suffix_array").option("path", str(tmp_path / "sa")).option("rows", 4).load()
    assert [(r.sparseness, r.pos) for r in rows.orderBy("rank").collect()] == [(3, v) for v in values]
    files.write_suffix_array(array.where("false"), str(tmp_path / "none"), 3, joined=False)
    assert files.read_suffix_array(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("sparseness", [1, 3])
def test_stored_array(spark, tmp_path, monkeypatch, sparseness):
    """Bounds and hits of a stored array against a walk over the text; only ranks around bounds are read."""
    draw = random.Random(sparseness + 10)
    sequences = ["".join(draw.choices("AILKC", k=draw.randrange(0, 40))) for _ in range(120)] + ["K" * 150, "IL" * 60, "IL" * 60, "", "A"]
    prepared = index.prepare(database(spark, sequences))
    array_search.write_array(index.suffix_array(prepared, sparseness), prepared, str(tmp_path / "sa"), sparseness, step=16)
    array = array_search.StoredArray(spark, str(tmp_path / "sa"), prepared)
    text = "-".join(sequences) + "$"
    same = lambda x: x.replace("L", "I")
    order = sorted(range(0, len(text), sparseness), key=lambda p: same(text[p:]))
    peptides = ["A", "I", "C", "K", "AIA", "KK", "K" * 100, "IL" * 50, "IL" * 50 + "A", "ZZ", "AAAA", sequences[3], sequences[5][2:9], "Y", "", "I-"]
    read, real = [], files.read_suffix_array
    monkeypatch.setattr(array_search, "read_suffix_array", lambda spark, path, spans: read.append(spans) or real(spark, path, spans))
    folded_ = spark.createDataFrame([(same(p).encode(),) for p in peptides if "-" not in p], "pep_il binary")
    got = {bytes(r.pep_il).decode(): (r.lo, r.hi) for r in array.bounds(folded_).collect()}
    starts = {same(p): [r for r, at in enumerate(order) if same(text[at : at + len(p)]) == same(p)] for p in peptides if p and "-" not in p}
    assert got == {p: (at[0], at[-1] + 1) for p, at in starts.items() if at}
    read.clear()
    array.bounds(folded_.where(F.col("pep_il") == b"A")).collect()
    assert 0 < sum(last - first + 1 for first, last in read[0]) <= 2 * 16 < got["A"][1] - got["A"][0] + 200
    for equalize in (False, True):
        fold = same if equalize else (lambda x: x)
        owner = [(i, at) for i, s in enumerate(sequences) for at in range(len(s) + 1)]
        rank = {p: r for r, p in enumerate(order)}
        want = set()
        for p in {*peptides}:
            for at in range(len(text)):
                if p and "-" not in p and len(p) >= sparseness and fold(text[at : at + len(p)]) == fold(p):
                    want.add((p, *owner[at], -at % sparseness, rank[at + -at % sparseness]))
        hits = array.occurrences(spark.createDataFrame([(p,) for p in peptides], "pep string"), equalize).collect()
        assert sorted(map(tuple, hits)) == sorted(want)


def test_stored_engine(spark, taxonomy, tmp_path):
    """A saved and opened database answers as the one it was saved from, also peptides with separators."""
    sequences = ["BOLTANVIL", "WIDGET", "", "LLIL", "IL", "L"]
    engine = PeptideEngine(database(spark, sequences, {3: 9, 4: 21}), taxonomy)
    engine.save(str(tmp_path / "db"))
    opened = PeptideEngine.open(spark, str(tmp_path / "db"))
    peptides = asked(spark, "BOLT", "BOLTANVIL", "I", "LI", "WIDGET", "L-L", "", "ZZ", "il\n", "ANVILX")
    for equalize in (False, True):
        rows = [sorted(e.search(peptides, equalize=equalize).collect()) for e in (engine, opened)]
        assert rows[0] == rows[1] and len(rows[0]) > 4
    assert opened.exists(peptides).orderBy("ord").collect() == engine.exists(peptides).orderBy("ord").collect()
    assert opened.taxon(peptides).orderBy("ord").collect() == engine.taxon(peptides).orderBy("ord").collect()
    with pytest.raises(Exception, match="(?i)path"):
        PeptideEngine.open(spark, str(tmp_path / "none"))


def test_stored_index_is_pruned(spark, taxonomy, tmp_path, monkeypatch):
    """Of a database in many files, a list reads those that hold its seeds and its proteins, however long it is."""
    draw = random.Random(2)
    sequences = ["".join(draw.choices("ACDEFGHIKLMNPQRSTVWY", k=60)) for _ in range(300)] + ["ÄÖ" * 4 + "WIDGET", "GG" + "K" * 40]
    monkeypatch.setattr(stored, "FILE_ROWS", 400)
    engine = PeptideEngine(database(spark, sequences), taxonomy)
    engine.save(str(tmp_path / "db"))
    opened = PeptideEngine.open(spark, str(tmp_path / "db"))
    read = []
    monkeypatch.setattr(stored.Ordered, "meeting", lambda self, keys: read.append((self.key, met(self, keys))) or meeting(self, keys))
    met, meeting = stored.Ordered.met, real_meeting
    size = lambda key: sum(len(files) for k, files in read if k == key)
    whole = len(opened.seeds.files)
    assert whole > 30

    def found(peptides, equalize=False):
        read.clear()
        rows = opened.occurrences(spark.createDataFrame([(p,) for p in peptides], "pep string"), equalize)
        got = sorted((r.pep, r.protein_idx) for r in rows.select("pep", "protein_idx").collect())
        fold = (lambda x: x.replace("L", "I")) if equalize else (lambda x: x)
        want = sorted((p, i) for p in {*peptides} - {""} for i, s in enumerate(sequences) for at in range(len(s)) if fold(s[at : at + len(p)]) == fold(p))
        assert got == want
        plan = rows._jdf.queryExecution().toString()
        assert all("fa:" not in x.split("ReadSchema")[1] for x in plan.splitlines() if "FileScan" in x)
        return size("seed")

    assert found([sequences[7][10:19]], True) == 1 and size("protein_idx") == 1
    assert found(["WIDGET", "WWWWWWWWW", "K" * 30]) <= 4
    assert found([s[3:12] for s in sequences[:5]], True) <= 10
    assert found([s[i : i + 9] for s in sequences for i in range(0, 50, 7)]) <= whole
    assert found(["AC", "W"]) < whole / 4  # a short peptide reads the range of seeds that start with it
    assert found(["OOOOOO"]) <= 1


def test_hot_seeds_are_split(spark, monkeypatch):
    """A third of all letters is poly-A: no part of a seed has more than its share, and the rows are the same."""
    draw = random.Random(4)
    sequences = ["".join(draw.choices("ACDEFGHIKLMNPQRSTVWY", k=40)) + "A" * 20 for _ in range(200)]
    prepared = index.prepare(database(spark, sequences))
    wanted = spark.createDataFrame([("A" * n,) for n in (5, 6, 19, 20)] + [(sequences[3][2:9],), ("WA",)], "pep string")
    rows = lambda df: sorted((r.pep, r.protein_idx, r.off) for r in df.select("pep", "protein_idx", "off").collect())
    near = rows(search.occurrences(prepared, wanted))
    monkeypatch.setattr(search, "BROADCAST_PEPTIDES", 0)
    assert rows(search.occurrences(prepared, wanted)) == near and len(near) > 3000
    assert rows(search.indexed_occurrences(index.seed_index(prepared), prepared, wanted)) == near
    seeds = index.seed_index(prepared).select("seed", "protein_idx", "off").repartition(3).cache()
    shards = 16
    split = {bytes(r.seed): r.parts for r in search.split_seeds(seeds, shards).collect()}
    sizes = seeds.groupBy("seed").count().collect()
    assert split[b"AAAAA"] > 3 and len(split) < search.HOT
    median = seeds.count() / shards
    assert all(r["count"] / split.get(bytes(r.seed), 1) <= 3 * median for r in sizes)
    part = F.pmod(F.xxhash64("protein_idx", "off"), F.lit(split[b"AAAAA"]))
    dealt = [r["count"] for r in seeds.where(F.col("seed") == b"AAAAA").groupBy(part).count().collect()]
    assert len(dealt) == split[b"AAAAA"] and max(dealt) < 2 * min(dealt)


def test_packed_and_missing_annotations(spark, taxonomy):
    rows = database(spark, ["AAC", "CAAC", "GG"]).withColumn("fa", F.when(F.col("protein_idx") == 2, "").otherwise(F.col("fa"))).withColumnRenamed("protein_idx", "line")
    plain, packed, none = (PeptideEngine.load(x, taxonomy, "line") for x in (rows, rows.withColumn("fa", annotations.pack(F.col("fa"))), rows.drop("fa")))
    answers = [{r.sequence: r for r in e.analyse(asked(spark, "AAC", "GG")).collect()} for e in (plain, packed, none)]
    assert answers[0] == answers[1] and answers[0]["GG"].fa.counts["all"] == 1 and not answers[0]["GG"].fa.data
    assert answers[2]["AAC"].fa.counts == {"all": 2, "EC": 0, "GO": 0, "IPR": 0} and answers[2]["AAC"].lca == answers[0]["AAC"].lca


def test_written_order(spark, taxonomy, tmp_path):
    engine = PeptideEngine(database(spark, ["AAC", "CAAC", "GG"]), taxonomy)
    wanted = ["GG", "A", "ZZ", "AAC", "C", "AA"] * 4
    write_json(engine.search(asked(spark, *wanted)), str(tmp_path / "out"))
    lines = [json.loads(x)["sequence"] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [x for x in wanted if x != "ZZ"]


def test_written_text(spark, taxonomy, tmp_path):
    """Lines in the order of the list and of the text, also where one answer is spread over files."""
    engine = PeptideEngine(database(spark, ["AACAA", "CAAC", "GG"] * 9), taxonomy)
    wanted = ["GG", "aa", "ZZ", "AA"]
    proteins = [s for s in ["AACAA", "CAAC", "GG"] * 9 for i in range(len(s)) if s.startswith("AA", i)]
    expected = {
        "matches": ["found 9 matches", *["* GG"] * 9, *["found 27 matches", *(f"* {s}" for s in proteins)], "found 0 matches", *["found 27 matches", *(f"* {s}" for s in proteins)]],
        "exists": ["true", "true", "false", "true"],
        "taxon": [str(r.taxon) if r.taxon else "/" for r in engine.taxon(asked(spark, *wanted)).orderBy("ord").collect()],
    }
    for mode, lines in expected.items():
        write_text(getattr(engine, mode)(asked(spark, *wanted)), str(tmp_path / mode))
        assert [x for p in sorted((tmp_path / mode).glob("part-*")) for x in p.read_text().splitlines()] == lines
    assert len(list((tmp_path / "matches").glob("part-*"))) > 1


def test_request_stream(spark, taxonomy, tmp_path):
    """Every request has one answer, also those without peptides or matches; a batch run again gives the same."""
    (tmp_path / "in").mkdir()
    lines = ['{"id": "a", "peptides": ["GG", "A", "ZZ", "A"]}', '{"peptides": ["AAC"], "cutoff": 1, "equalize_I_and_L": true}', '{"id": "none", "peptides": []}', '{"id": "zz", "peptides": ["ZZ"]}', '{"id": "a", "peptides": ["GG", "A", "ZZ", "A"]}']
    lines += ['{"id": "il", "peptides": ["AIC"], "equalize_I_and_L": true}', '{"id": "exact", "peptides": ["AIC"]}', '{"id": "clean", "peptides": ["GG"], "clean_taxa": true}', '{"id": "null"}']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    engine = PeptideEngine(database(spark, ["AAC", "CAAC", "GG", "ALC"], {2: 21}), taxonomy)
    engine.save(str(tmp_path / "db"))
    for number, e in enumerate((engine, PeptideEngine.open(spark, str(tmp_path / "db")))):
        out = str(tmp_path / f"out{number}")
        before = len(list(pathlib.Path(settle.shared_path(spark, "x").removeprefix("file:")).parent.iterdir()))
        answer_stream(e, read_requests(spark, str(tmp_path / "in")), out, str(tmp_path / f"state{number}"), "search").awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert len(rows) == len(lines)
        answers = {(r.request, r.nth): [(x["sequence"], len(x["proteins"]), x["cutoff_used"]) for x in json.loads(r.json)["result"]] for r in rows}
        named = {k: v for k, v in answers.items() if len(k[0]) < 10}
        assert named == {("a", 0): [("GG", 1, False), ("A", 5, False), ("A", 5, False)], ("a", 1): named["a", 0], ("none", 0): [], ("zz", 0): [], ("il", 0): [("AIC", 1, False)], ("exact", 0): [], ("clean", 0): [("GG", 0, False)], ("null", 0): []}
        assert [v for k, v in answers.items() if len(k[0]) == 64] == [[("AAC", 1, True)]]
        after = len(list(pathlib.Path(settle.shared_path(spark, "x").removeprefix("file:")).parent.iterdir()))
        assert after - before <= (12 if number == 0 else 0)  # nothing stays but, at first, the taxonomy's paths
    batch = files.requests(spark.read.text(str(tmp_path / "in")))
    assert sorted(answer_batch(engine, batch, "analyse").collect()) == sorted(answer_batch(engine, batch, "analyse").collect())


def test_hit_stream(spark, taxonomy, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "x", "peptides": ["WIDGET", "I", "BOITANVII"], "equalize_I_and_L": true}\n{"id": "y", "peptides": ["BOITANVII", "widget"]}\n')
    engine = PeptideEngine(database(spark, ["BOLTANVIL", "AWIDGETWIDGET"]), taxonomy)
    hits = hit_stream(engine, read_requests(spark, str(tmp_path / "in")))
    assert hits.isStreaming
    hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.request, r.at, r.protein_idx, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("x", 0, 1, 11), ("x", 0, 1, 17), ("x", 2, 0, 0), ("y", 1, 1, 11), ("y", 1, 1, 17)]


def test_sql_text(spark, taxonomy):
    """Functions in SQL text agree with those of columns; a search becomes an equi-join."""
    sql.functions(spark)
    rows = spark.createDataFrame(PACKED + [(None, None), ("NO:1;GO:0000001", None)], "fa string, hex string")
    got = spark.sql("SELECT fa, hex(pack_annotations(fa)) AS packed, unpack_annotations(pack_annotations(fa)) AS back FROM {rows}", rows=rows)
    want = rows.select("fa", F.hex(annotations.pack(F.col("fa"))).alias("packed"), annotations.unpack(annotations.pack(F.col("fa"))).alias("back"))
    assert got.collect() == want.collect()
    for wrong in ("pack_annotations('EC:x')", "unpack_annotations(X'FF')"):
        with pytest.raises(Exception, match="cannot"):
            spark.sql(f"SELECT {wrong}").collect()
    sql.register(PeptideEngine(database(spark, ["BOLTANVILWIDGETSLONG", "WIDGET", "LLIL"]), taxonomy))
    asked_ = asked(spark, "BOLTANVILWIDGETSLONG", "widget\n", "BOLTANVILWIDGETSLOX", "LI", "LL")
    query = "SELECT q.ord, m.protein_idx, m.off FROM {q} q, LATERAL %s(q.sequence, %s) m JOIN proteins p ON p.protein_idx = m.protein_idx AND matches_at(p.sequence, m.off, q.sequence, %s)"
    hits = lambda f, e: spark.sql(query % (f, e, e), q=asked_)
    assert sorted(map(tuple, hits("matches", "false").collect())) == [(0, 0, 0), (1, 0, 9), (1, 1, 0)]
    assert sorted(map(tuple, hits("short_matches", "false").collect())) == [(3, 2, 1), (4, 2, 0)]
    assert sorted(map(tuple, hits("short_matches", "true").collect())) == sorted((ord_, *at) for ord_ in (3, 4) for at in ((0, 7), (2, 0), (2, 1), (2, 2)))
    plan = hits("matches", "true")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_dictionary_grows_at_its_end(spark):
    first = spark.createDataFrame([(1, "GO:5;GO:3"), (2, None)], "k int, fa string")
    second = spark.createDataFrame([(3, "GO:1;GO:3;GO:4;"), (4, "")], "k int, fa string")
    one = annotations.extend_dictionary(spark.createDataFrame([], "code int, annotation string"), first, "fa")
    two = annotations.extend_dictionary(one, second, "fa")
    assert sorted(map(tuple, two.collect())) == [(0, "GO:3"), (1, "GO:5"), (2, "GO:1"), (3, "GO:4")]
    codes = annotations.encode_codes(first, "k", "fa", one).union(annotations.encode_codes(second, "k", "fa", two))
    assert {r.k: r.text for r in annotations.decode_codes(codes, "k", "codes", two).collect()} == {1: "GO:5;GO:3", 2: "", 3: "GO:1;GO:3;GO:4", 4: ""}
    assert annotations.extend_dictionary(two, second, "fa").count() == 4


def test_plans(spark, monkeypatch):
    prepared = index.prepare(database(spark, ["BOLTANVIL", "WIDGET"]))
    hits = search.occurrences(prepared, spark.createDataFrame([("BOLT",)], "pep string"))
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    kept = []
    monkeypatch.setattr(search, "settle", lambda df: kept.append(df) or df)
    search.first_hits(hits, prepared, 5)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    carried = next(x for x in plan.splitlines() if "Project" in x and "_head" in x)
    assert "closed#" not in carried.split("substring(closed")[0]


def test_tables_of_small_files_are_not_broadcast(spark):
    # A million rows of one value are a few kB of Parquet, and would all go through the driver.
    rows = settle.settle(spark.range(1_000_000).select((F.col("id") % 10).alias("k"), F.lit("SAME").alias("text")))
    other = settle.settle(spark.range(1_000_000).select((F.col("id") % 1000).alias("k")))
    for how in ("inner", "left", "left_semi"):
        assert "Broadcast" not in rows.join(other, "k", how)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in rows.join(F.broadcast(other.distinct()), "k")._jdf.queryExecution().executedPlan().toString()


def test_occurrences_of_a_stored_index_are_not_broadcast(spark, taxonomy, tmp_path):
    PeptideEngine(database(spark, ["MLPGLALLLLAAW", "PTDGNAGLLAE", "MLPGLALLLLAAW"] * 20), taxonomy).save(f"{tmp_path}/db")
    engine = PeptideEngine.open(spark, f"{tmp_path}/db")
    hits = engine.occurrences(spark.createDataFrame([("GLALL",), ("GNAG",)], "pep string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert hits.count() == 60


def test_rounds_of_ranks_grow_with_few_of_them(spark, monkeypatch):
    sequences = ["AC", "KR", "AC", "AC", "LM"] * 40  # the whole text repeats, so most places are told apart by its end only
    calls = []
    numbered = index.numbered
    monkeypatch.setattr(index, "numbered", lambda *a: calls.append(a) or numbered(*a))
    rows = index.prepare(database(spark, sequences)).collect()
    text = ["-".join(s.replace("L", "I") for s in sequences[i:]) + "$" for i in range(len(sequences))]
    want = sorted(range(len(text)), key=lambda i: text[i])
    got = sorted((r for r in rows if r.tail), key=lambda r: r.tail)
    assert [r.protein_idx + 1 for r in got] == [i for i in want if i]
    assert len(calls) <= 1 + 3  # 200 places: eight in each round, not two


def test_answers_pass_no_join(spark, taxonomy, tmp_path):
    """Finding F1: an answer, which may be large, is put together last and goes through no join."""
    (tmp_path / "one.json").write_text('{"id": "a", "peptides": ["GG"]}\n{"id": "none", "peptides": []}\n')
    batch = files.requests(spark.read.text(str(tmp_path / "one.json")))
    engine = PeptideEngine(database(spark, ["AAC", "GG"], {}), taxonomy)
    made = answer_batch(engine, batch, "search")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Aggregate")]
    assert {r.request: len(json.loads(r.json)["result"]) for r in made.collect()} == {"a": 1, "none": 0}


def test_large_answers_are_put_together_apart(spark, taxonomy, tmp_path, monkeypatch):
    """Finding F3 of round 4: a result that an answer holds many times is moved once, and large answers are no one task's."""
    lines = [{"id": f"r{i}", "peptides": ["GG", "AAC", "ZZ", "GG", "AAC"][: i % 6] * (1 + i)} for i in range(9)]
    (tmp_path / "all.json").write_text("\n".join(map(json.dumps, lines)))
    batch = files.requests(spark.read.text(str(tmp_path / "all.json")))
    engine = PeptideEngine(database(spark, ["AAC", "GG", "GGA"]), taxonomy)
    small = {r.request: r.json for r in answer_batch(engine, batch, "search").collect()}
    for line in lines:
        assert [x["sequence"] for x in json.loads(small[line["id"]])["result"]] == [x for x in line["peptides"] if x != "ZZ"]
    parts = requests_module.answer_parts(engine, batch, "search")
    assert parts.where("json is not null").count() == sum(len(set(x["peptides"]) - {"ZZ"}) for x in lines)
    monkeypatch.setattr(requests_module, "LARGE_BYTES", 200)
    monkeypatch.setattr(requests_module, "LARGE_ROWS", 2)
    made = requests_module.whole_answers(settle.settle(parts))
    assert {r.request: r.json for r in made.collect()} == small
    large = [r.n for r in made.where("length(json) > 200").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(large) == sum(len(x) > 200 for x in small.values()) >= 5 and max(large) <= 2


def test_copies_are_listed_when_hits_are_read(spark, taxonomy, tmp_path, monkeypatch):
    """Finding F2 of round 4: with 30 copies of a protein and of a peptide, the stream writes a row for each peptide, not 900."""
    monkeypatch.setattr(requests_module, "COPIES", 7)  # a text in several parts
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "x", "peptides": ["WIDGET"] * 30 + ["I", "BOLTA"]}))
    engine = PeptideEngine(database(spark, ["AWIDGET", "BOLTANVIL"] * 30 + ["WIDGETWIDGET"]), taxonomy)
    texts = requests_module.Texts(engine)
    stream = lambda: read_requests(spark, str(tmp_path / "in"))
    written = []
    for name, hits in (("texts", texts.hit_stream(stream())), ("all", hit_stream(engine, stream()))):
        hits.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start().awaitTermination()
        written.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert written[0].count() == 30 * 3 + 1 and written[1].count() == 30 * 32 + 30
    assert sorted(texts.occurrences(written[0]).collect()) == sorted(written[1].collect())
