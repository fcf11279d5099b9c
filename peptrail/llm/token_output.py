"""Token ids as Arrow files of equal-length sequences and masks.

Documents are dealt out by ranges of doc_id and each range becomes one uncompressed Arrow
IPC file whose record batches hold fixed-size lists: ``ids[L]`` and ``mask[L]``, false on the
padding after the file's last id. A memory-mapped file gives any sequence without a copy.
Beside it lies a small Arrow file that names each document's place in the file's id stream.
Ids are 16 bits wide where the vocabulary allows it and 32 bits otherwise.

Words (runs without ASCII white space) recur, and the tokenizers used here never look across
white space, so each distinct word is encoded once by the tokenizers library and its ids are
dealt to every occurrence. ``WordEncoder`` checks that the tokenizer's file has that form and
encodes whole texts otherwise.

Edge cases: a null text counts as empty and yields the end id alone; rows with equal doc_ids
are written in the order of their texts and each returned; a null doc_id comes last; an empty
table gives no files and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch, textscan

END_ID = 1
SEQUENCE = 1024
ROWS_A_BATCH = 256
#: Distinct words that a task remembers; beyond it, it starts anew.
REMEMBERED = 2_000_000
GROUP = 256
LATIN = "\u0250"  # the letters below are letters in every version of Unicode
# The steps under which a word's ids depend on nothing beyond its white space.
WORD_STEPS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def hashes_of(words: list[str]) -> np.ndarray:
    """The hashes that these words, none of them with white space, have in a text."""
    return np.concatenate([np.empty(0, textscan.U), *(b.hashes() for b in textscan.blocks(pa.array(words, pa.string())))])


class WordEncoder:
    """Ids of words by their hashes: sorted hashes with offsets into one array of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        steps = [x.get("type") for x in (form.get("normalizer") or {}).get("normalizers", [])]
        model = form["model"]
        suffix = model.get("end_of_word_suffix")
        splits = (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        words = [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": WORD_SPLIT} and not splits[1].get("add_prefix_space")
        self.by_word = bool(suffix) and steps == WORD_STEPS and words and not form.get("post_processor")
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, dtype=bool)
        if suffix:
            self.ends[[i for x, i in model["vocab"].items() if x.endswith(suffix)]] = True
        self.width = np.uint16 if size <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, textscan.U)
        self.at = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, self.width)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Runs of letters go through in groups; a group whose number of word
        ends is not the number of its words is encoded word by word."""
        out: list = [None] * len(words)
        plain, single = [], []
        for i, w in enumerate(words):
            if w.isalpha():
                plain.append((i, w))
            else:
                single.append(i)
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        for group, ids in zip(groups, self.encode([" ".join(x[1] for x in g) for g in groups]), strict=True):
            ids = np.array(ids, dtype=self.width)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):
                single += [x[0] for x in group]
                continue
            for (i, _), a, b in zip(group, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                out[i] = ids[a:b]
        for i, ids in zip(single, self.encode([words[i] for i in single]), strict=True):
            out[i] = np.array(ids, dtype=self.width)
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among the known ones, and whether it does."""
        place = np.searchsorted(self.known, hashes)
        there = np.zeros(len(hashes), dtype=bool)
        inside = place < len(self.known)
        there[inside] = self.known[place[inside]] == hashes[inside]
        return place, there

    def add(self, hashes: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        known, first = np.unique(np.concatenate([self.known, hashes]), return_index=True)
        self.known, self.at, self.count = known, np.concatenate([self.at, at])[first], np.concatenate([self.count, count])[first]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words. Capitals and the marks behind a word change neither each other's
        ids nor the word's, so a word of Latin letters is encoded once, in lower case. A letter
        whose small form is more than letters (a dotted capital I) would take the marks along."""
        parts: dict[str, int] = {}
        head, tail = np.empty(len(words), np.int64), np.full(len(words), -1, np.int64)
        for i, w in enumerate(words):
            if w.isalpha():
                base, marks = w, None
            elif (m := LETTERS_MARKS.fullmatch(w)) and max(m[1]) < LATIN and m[1].lower().isalpha():
                base, marks = m[1], m[2]
            else:
                base, marks = w, None
            if max(base) < "\u0100" and base.isalpha():
                base = base.lower()
            head[i] = parts.setdefault(base, len(parts))
            if marks:
                tail[i] = parts.setdefault(marks, len(parts))
        names = list(parts)
        keys = hashes_of(names)
        place, there = self.find(keys)
        new = np.flatnonzero(~there)
        found = self.words([names[i] for i in new])
        count = np.array([len(x) for x in found], dtype=np.int64)
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *found])
        self.add(keys[new], at, count)
        place, _ = self.find(keys)
        at, count = self.at[place], self.count[place]
        # A word with marks has the ids of both, one after the other.
        two = tail >= 0
        word_at, word_count = at[head], count[head]
        a, b = count[head[two]], count[tail[two]]
        begin = np.cumsum(a + b) - (a + b)
        joined = np.empty((a + b).sum(), dtype=self.width)
        for start, n, source in ((begin, a, at[head[two]]), (begin + a, b, at[tail[two]])):
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            joined[np.repeat(start, n) + steps] = self.ids[np.repeat(source, n) + steps]
        word_at[two], word_count[two] = len(self.ids) + begin, a + b
        self.ids = np.concatenate([self.ids, joined])
        self.add(hashes, word_at, word_count)

    def block(self, block: textscan.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows one after another, each row closed by the end id, and their counts."""
        if not self.by_word:
            rows = [np.array([*x, END_ID], dtype=self.width) for x in self.encode([block.text(i).decode() for i in range(block.rows)])]
            return np.concatenate(rows), np.array([len(x) for x in rows], dtype=np.int64)
        distinct, where, inverse = np.unique(block.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.clear()
        place, there = self.find(distinct)
        if not there.all():
            raw = block.data.tobytes()
            self.learn(distinct[~there], [raw[block.starts[i] : block.ends[i]].decode() for i in where[~there]])
            place, _ = self.find(distinct)
        at, count = self.at[place][inverse], self.count[place][inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        per_row = total[block.first[1:]] - total[block.first[:-1]] + 1
        out = np.full(per_row.sum(), END_ID, dtype=self.width)
        rows = block.row
        target = total[:-1] + rows  # each row before adds one end id
        steps = np.arange(total[-1]) - np.repeat(total[:-1], count)
        out[np.repeat(target, count) + steps] = self.ids[np.repeat(at, count) + steps]
        return out, per_row


_encoders: dict[str, WordEncoder] = {}


def _schema(width, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceFile:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, fs, path: str, width, sequence: int):
        self.sequence, self.width, self.schema = sequence, width, _schema(width, sequence)
        self.stream = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.stream, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.sequence * ROWS_A_BATCH:
            self.flush(self.sequence * ROWS_A_BATCH)

    def flush(self, step: int) -> None:
        ids = np.concatenate(self.waiting)
        end = len(ids) // step * step
        for at in range(0, end, step):
            self.write(ids[at : at + step], step)
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def write(self, ids: np.ndarray, padded: int) -> None:
        full, mask = np.zeros(padded, dtype=self.width), np.zeros(padded, dtype=bool)
        full[: len(ids)], mask[: len(ids)] = ids, True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (full, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            rest = np.concatenate(self.waiting)
            self.write(rest, -(-len(rest) // self.sequence) * self.sequence)
        self.writer.close()
        self.stream.close()


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _write(folder: str, tokenizer: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if tokenizer not in _encoders:  # Python workers are reused, and so are the words they know
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        part = TaskContext.get().partitionId()
        fs, path = scratch.open_fs(folder)
        name, draft = f"{path}/part-{part:06d}", f"{path}/.{uuid.uuid4().hex}"  # a second attempt never meets the first one's draft
        file, ids, counts, total = None, [], [], 0
        for batch in batches:
            if file is None and batch.num_rows:
                fs.create_dir(path, recursive=True)
                file = SequenceFile(fs, draft, encoder.width, sequence)
            ids.append(batch.column("doc_id"))
            for block in textscan.blocks(batch.column("text"), 8 * textscan.BLOCK):
                tokens, per_row = encoder.block(block)
                file.add(tokens)
                counts.append(per_row)
                total += len(tokens)
        if file is None:
            return
        file.close()
        fs.move(draft, f"{name}.arrow")
        counts = np.concatenate(counts)
        table = pa.Table.from_arrays([pa.chunked_array(ids), pa.array(np.cumsum(counts) - counts), pa.array(counts)], schema=DOCS)
        with fs.open_output_stream(f"{draft}.docs") as out, pa.ipc.new_file(out, DOCS) as writer:
            writer.write_table(table, max_chunksize=10_000)
        fs.move(f"{draft}.docs", f"{name}.docs.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([len(counts)], pa.int64())], ["part", "n_tokens", "n_docs"])

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write ``docs`` as token files; returns one row per file: file, start, n_tokens, n_docs.

    ``start`` is the number of ids in all files before it: the only whole-corpus sum, over
    one row per file.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    files = rows.repartitionByRange(ranges, order).sortWithinPartitions(order, "text").mapInArrow(_write(folder, tokenizer, sequence), "part int, n_tokens long, n_docs long").collect()
    listed, start = [], 0
    for f in sorted(files):
        listed.append((f"{folder}/part-{f.part:06d}", start, f.n_tokens, f.n_docs))
        start += f.n_tokens
    return spark.createDataFrame(listed, "file string, start long, n_tokens long, n_docs long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = scratch.open_fs(row["file"])
            with fs.open_input_file(f"{path}.docs.arrow") as a, fs.open_input_file(f"{path}.arrow") as b:
                index, sequences = pa.ipc.open_file(a), pa.ipc.open_file(b)
                nth, held = 0, np.empty(0, np.uint32)
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    sums = []
                    for need in docs.column("n_tokens").to_pylist():
                        crc, left = 0, need
                        while left:
                            if not len(held):
                                part = sequences.get_batch(nth)
                                nth += 1
                                held = part.column("ids").flatten().to_numpy(zero_copy_only=True)[part.column("mask").flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                            crc, held, left = zlib.crc32(held[:left].tobytes(), crc), held[left:], left - min(left, len(held))
                        sums.append(crc)
                    start = pa.array(docs.column("start").to_numpy() + row["start"])
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return files.repartition(max(1, files.count()), "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence_at(file: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``i`` of a file and its mask, from a memory map; the ids are not copied."""
    fs, path = scratch.open_fs(file)
    with pa.memory_map(f"{path}.arrow") as source:
        batch = pa.ipc.open_file(source).get_batch(i // ROWS_A_BATCH)
        row = i % ROWS_A_BATCH
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)
