"""Readers and writers of protein, taxonomy, peptide, request and suffix-array files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from peptrail.functions.annotations import unpack
from peptrail.operators.settle import ordered_lines
from peptrail.operators.taxonomy import known

#: Names of a suffix array's parts start so; the first rank follows.
PART = "part-"
REQUEST = "id string, peptides array<string>, cutoff bigint, equalize_I_and_L boolean, clean_taxa boolean"


def _fields(spark: SparkSession, path: str, n: int, encoding: str = "UTF-8") -> DataFrame:
    """``(line, f)`` of a tab-separated file without a header; a row with another number of fields is an error."""
    raw = spark.read.option("encoding", encoding).csv(path, sep="\x03", quote="\x02", schema="value string", mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    lines = ordered_lines(raw, [F.col("value")], "line")
    f = F.split(F.col("value"), "\t", -1)
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} fields: "), F.col("value")))
    return lines.select("line", F.when(F.size(f) == n, f).otherwise(wrong.cast("array<string>")).alias("f"))


def read_proteins(spark: SparkSession, path: str, taxonomy: DataFrame, annotations: str = "text") -> DataFrame:
    """``(line, uniprot_id, taxon_id, sequence, fa)`` of known taxa from a file with packed annotations.

    The packed bytes are no text; ISO-8859-1 carries them through the line reader unchanged.
    ``annotations``: ``text``; ``packed``, which an engine unpacks for its hits only; or ``none``.
    """
    f = _fields(spark, path, 4, "ISO-8859-1")
    rows = f.select("line", f.f[0].alias("uniprot_id"), f.f[1].cast("long").alias("taxon_id"), F.upper(f.f[2]).alias("sequence"), F.encode(f.f[3], "ISO-8859-1").alias("fa"))
    if annotations == "none":
        rows = rows.drop("fa")
    elif annotations == "text":
        rows = rows.withColumn("fa", unpack(F.col("fa")))
    return known(rows, taxonomy)


def read_plain_proteins(spark: SparkSession, path: str, taxonomy: DataFrame) -> DataFrame:
    """``(line, uniprot_id, taxon_id, sequence)`` of known taxa from a file of three columns."""
    f = _fields(spark, path, 3)
    return known(f.select("line", f.f[0].alias("uniprot_id"), f.f[1].cast("long").alias("taxon_id"), F.upper(f.f[2]).alias("sequence")), taxonomy)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name, rank, parent, valid)``; ``valid`` is a byte 1 or 0, white space after it is ignored."""
    f = _fields(spark, path, 5)
    return f.select(f.f[0].cast("long").alias("id"), f.f[1].alias("name"), f.f[2].alias("rank"), f.f[3].cast("long").alias("parent"), (F.substring(f.f[4], 1, 1) == "\x01").alias("valid"))


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, sequence)``: one peptide a line."""
    return ordered_lines(spark.read.text(path), [F.col("value").alias("sequence")], "ord")


def requests(lines: DataFrame, cutoff: int = 10_000) -> DataFrame:
    """``(request, peptides, cutoff, equalize, clean)`` of JSON ``lines(value[, source])``, with the defaults of fields left out.

    ``request`` is the field ``id``; where that is left out, a hash of the line and its source.
    """
    x = F.from_json("value", REQUEST, {"mode": "FAILFAST"})
    key = F.sha2(F.concat_ws("\n", *(c for c in ("source", "value") if c in lines.columns)), 256)
    return lines.select(x.alias("x"), key.alias("key")).select(F.coalesce("x.id", "key").alias("request"), F.coalesce("x.peptides", F.array().cast("array<string>")).alias("peptides"), F.coalesce("x.cutoff", F.lit(cutoff)).alias("cutoff"), F.coalesce("x.equalize_I_and_L", F.lit(False)).alias("equalize"), F.coalesce("x.clean_taxa", F.lit(False)).alias("clean"))


class SuffixArrayFile(DataSource):
    """A byte with the sparseness, then little-endian 64-bit positions in rank order.

    Files are opened by ``pyarrow.fs``, so a path may be a URI of any store it knows. Reading:
    ``(sparseness, rank, pos)``, in ranges of ``rows`` positions, of a file or of a folder of
    parts, each such a file named by its first rank; with ``spans`` (``first-last,…``, ascending) only
    those ranks. Writing: ``(rank, pos)``, each task its
    part; the driver names the parts, or joins them to one file if it is asked to.
    """

    @classmethod
    def name(cls) -> str:
        return "suffix_array"

    def schema(self) -> str:
        return "sparseness int, rank long, pos long"

    def reader(self, schema):
        spans = self.options.get("spans")
        wanted = None if spans is None else [tuple(map(int, x.split("-"))) for x in spans.split(",") if x]
        return _ArrayReader(self.options["path"], int(self.options.get("rows", 1 << 22)), wanted)

    def writer(self, schema, overwrite):
        return _ArrayWriter(self.options["path"], int(self.options.get("sparseness", 1)), self.options.get("joined", "false") == "true")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Runs(InputPartition):
    """Runs ``(first position in the file, positions, first rank)`` of a file."""

    def __init__(self, file: str, runs: list[tuple[int, int, int]]):
        self.file, self.runs = file, runs


class _ArrayReader(DataSourceReader):
    def __init__(self, path: str, rows: int, spans: list[tuple[int, int]] | None):
        self.path, self.rows, self.spans = path, rows, spans

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, path = _fs(self.path)
        info = fs.get_file_info(path)
        files = [(info, 0)]
        if info.type == FileType.Directory:
            files = [(f, int(f.base_name.removeprefix(PART))) for f in fs.get_file_info(FileSelector(path)) if f.base_name.startswith(PART)]
        out = []
        for f, rank in files:
            if not f.size or (f.size - 1) % 8:
                raise ValueError(f"{f.path} is not a suffix array file")
            n = (f.size - 1) // 8
            spans = [(rank, rank + n - 1)] if self.spans is None else self._inside(rank, n)
            cut = [(at - rank, min(self.rows, last + 1 - at), at) for first, last in spans for at in range(first, last + 1, self.rows)]
            runs, held = [], 0
            for run in cut:  # short runs share a task
                if runs and held + run[1] > self.rows:
                    out.append(_Runs(f.path, runs))
                    runs, held = [], 0
                runs.append(run)
                held += run[1]
            if runs:
                out.append(_Runs(f.path, runs))
        return out or [_Runs(files[0][0].path, [])]

    def _inside(self, rank: int, n: int) -> list[tuple[int, int]]:
        cut = ((max(first, rank), min(last, rank + n - 1)) for first, last in self.spans)
        return [(first, last) for first, last in cut if first <= last]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        fs, _ = _fs(self.path)
        with fs.open_input_file(partition.file) as f:
            sparseness = f.read(1)[0] if partition.runs else 0
            for at, left, first in partition.runs:
                f.seek(1 + 8 * at)
                while left and (raw := f.read(8 * min(left, 1 << 17))):
                    pos = np.frombuffer(raw, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), sparseness, np.int32)), pa.array(np.arange(first, first + len(pos))), pa.array(pos)], ["sparseness", "rank", "pos"])
                    first, left = first + len(pos), left - len(pos)


class _Part(WriterCommitMessage):
    def __init__(self, first: int, file: str):
        self.first, self.file = first, file


class _ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sparseness: int, joined: bool):
        self.path, self.sparseness, self.joined = path, sparseness, joined

    def write(self, batches):
        import uuid

        fs, path = _fs(self.path)
        if not self.joined:
            fs.create_dir(path)
        file, first = f"{path}{'.' if self.joined else '/.'}{uuid.uuid4().hex}", -1
        with fs.open_output_stream(file) as out:
            out.write(bytes([self.sparseness]))
            for batch in batches:
                if batch.num_rows:
                    first = batch.column("rank")[0].as_py() if first < 0 else first
                    out.write(batch.column("pos").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        return _Part(first, file)

    def commit(self, messages):
        fs, path = _fs(self.path)
        parts = sorted((m for m in messages if m), key=lambda m: m.first)
        for part in (p for p in parts if p.first < 0):
            fs.delete_file(part.file)
        parts = [p for p in parts if p.first >= 0]
        if not self.joined:
            for part in parts:
                fs.move(part.file, f"{path}/{PART}{part.first:020d}")
            if not parts:
                fs.create_dir(path)
                with fs.open_output_stream(f"{path}/{PART}{0:020d}") as out:
                    out.write(bytes([self.sparseness]))
            return
        with fs.open_output_stream(path) as out:
            out.write(bytes([self.sparseness]))
            for part in parts:
                with fs.open_input_stream(part.file) as f:
                    f.read(1)
                    while block := f.read(1 << 24):
                        out.write(block)
                fs.delete_file(part.file)

    def abort(self, messages):
        fs, _ = _fs(self.path)
        for part in messages:
            if part:
                fs.delete_file(part.file)


def write_suffix_array(array: DataFrame, path: str, sparseness: int, joined: bool = False) -> None:
    """Write ``array(rank, pos)`` in parallel by ranges of ranks: as a folder of parts, or joined to one file.

    Of a folder the driver only names the parts. It copies them into the one file, which is for
    exchange with other programs; parts after the first, without their first byte, can be
    put together by a store's own means as well.
    """
    spark = array.sparkSession
    spark.dataSource.register(SuffixArrayFile)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = array.select("rank", "pos").repartitionByRange(shards, "rank").sortWithinPartitions("rank")
    dealt.write.format("suffix_array").option("path", path).option("sparseness", sparseness).option("joined", str(joined).lower()).mode("append").save()


def read_suffix_array(spark: SparkSession, path: str, spans: list | None = None) -> DataFrame:
    """``(sparseness, rank, pos)``; with ``spans``, ascending pairs of a first and a last rank, only those are read."""
    spark.dataSource.register(SuffixArrayFile)
    reader = spark.read.format("suffix_array").option("path", path)
    if spans is not None:
        reader = reader.option("spans", ",".join(f"{first}-{last}" for first, last in spans))
    return reader.load()
