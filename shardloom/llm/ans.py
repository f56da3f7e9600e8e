"""Token-id files coded by a static range asymmetric numeral system.

A corpus is a folder with two folders of files: `frequencies` (one file: the quantised counts of all ids of the corpus,
u32 each, shared by every block) and `shards` (the documents in ascending doc_id order).  Spark writes them as raw bytes
through whatever store the folder lies in, one image a file, each with a newline behind it that is not part of the image.

A file image holds, little-endian:
  b"RNS2", crc32 of the rest (u32), number of documents, of symbols and of blocks (u64 each), the file's part and its
  number within the part (u32 each; files follow one another by these),
  doc ids (i64), a mask of null ids (u8), symbols per document (u32), bytes per block (u32), the blocks.
A block holds `LANES` interleaved coder lanes of `STEPS` symbols each, coded on its own:
  crc32 of the rest (u32), number of words (u32), then for each checkpoint (every `EVERY` steps) the position in the
  words (u32) and the states of all lanes (u64 each), then the words (u32).
Decoding can begin at any checkpoint, and all checkpoints of all blocks are decoded side by side.

Defined cases: a null text is an empty one and holds the end id alone; rows with a null doc_id come first; rows of one
doc_id, or without one, come in the order of a hash of their ids, and repeated rows one after the other; a very long text is coded
whole, over as many blocks as it takes; other columns are ignored; an empty table gives a corpus without shards and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, materialise, modest_batches, scratch_path, slices, small

SCALE = 20
LOW = np.uint64(1 << 31)
LANES, STEPS, EVERY = 128, 512, 128
BLOCK = LANES * STEPS
#: Symbols of a file image at least, before the next one begins.
SHARD = 1 << 20
END_ID = 2
#: Remembered chunks per worker, and bytes of texts that are encoded in one go.
MEMORY, SLICE = 400_000, 4 << 20

# ---------------------------------------------------------------- tokens

#: Texts of these characters alone can be cut at blanks and lower-cased letter by letter as the library does it.
_PLAIN = r"^[\t\n\r\x20-\x7e\x{a1}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}\x{2010}-\x{2027}\x{20ac}]*$"


#: Marks that the pattern joins into one pre-token; an apostrophe may begin another.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of whole texts by the library, which sees each blank-delimited chunk once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # ids that end a pre-token, where the vocabulary marks them
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(1 << 16, bool)
        if suffix:
            self.ends[[k for t, k in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self._clear()

    @property
    def number(self) -> pa.Array:
        """Remembered chunks; a chunk's number is its place."""
        return self.names

    def _clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat, self.used = np.zeros(1 << 20, np.uint16), 0
        self.start, self.length, self.uses = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _append(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember chunks whose ids follow one another."""
        k, n = len(self.names), len(names)
        while k + n > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.length[k : k + n], self.uses[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths, 0
        self.names = pa.concat_arrays([self.names, names])
        self.used += len(ids)

    def _known(self, names: pa.Array) -> np.ndarray:
        """The numbers of chunks, -1 for those that aren't remembered."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy()

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered chunks one after another, and how many each has."""
        lens = self.length[which]
        ends = np.cumsum(lens, dtype=np.int64)
        return self.flat[np.repeat(self.start[which] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)], lens

    def _forget(self) -> None:
        """Keep what was used more than once since it was learnt, the most used half of what there is room for."""
        names, uses = self.names, self.uses[: len(self.names)]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > MEMORY // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: MEMORY // 2]])
        ids, lens = self._gather(keep)
        self._clear()
        self._append(names.take(pa.array(keep)), ids, lens)

    def rest(self) -> None:
        """Hold less until the next task: what was used more than once, and no more than half of what there is room for."""
        if len(self.names) > MEMORY // 2:
            self._forget()

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Learn different chunks that aren't remembered; their numbers."""
        # letters and a run of marks after them are pre-tokens of their own, so their ids follow one another
        alone, ended, heads, tails, other = [], [], [], [], []
        for c in chunks:
            if c.isalpha():
                alone.append(c)
                continue
            head = c.rstrip(MARKS)
            if head is not c and head.isalpha():
                ended.append(c)
                heads.append(head)
                tails.append(c[len(head) :])
            else:
                other.append(c)
        number: dict[str, int] = {}
        parts = list(set(heads).difference(alone)) + list(set(tails).difference(other))
        if parts:
            for c, k in zip(parts, self._known(pa.array(parts, pa.string())).tolist(), strict=True):
                if k >= 0:
                    number[c] = k
                else:
                    (alone if c.isalpha() else other).append(c)
        # words of letters alone are one pre-token each, and may share a line
        each: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        fresh = (self._lines(alone, each) if self.ends.any() else alone) + other
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            found = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            each.append((part, np.array([x for ids in found for x in ids], np.uint16), np.array([len(x) for x in found], np.int64)))
        if each:
            names = [c for part, _, _ in each for c in part]
            number.update(zip(names, range(len(self.names), len(self.names) + len(names)), strict=True))
            self._append(pa.array(names, pa.string()), np.concatenate([ids for _, ids, _ in each]), np.concatenate([lens for _, _, lens in each]))
        if ended:
            pairs = np.stack([np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in (heads, tails)], axis=1)
            ids, lens = self._gather(pairs.ravel())
            number.update(zip(ended, range(len(self.names), len(self.names) + len(ended)), strict=True))
            self._append(pa.array(ended, pa.string()), ids, lens.reshape(-1, 2).sum(axis=1))
        return np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))

    def _lines(self, words_: list[str], each: list, width: int = 200) -> list[str]:
        """Encode lines of words and cut the ids where words end; gives the words of lines where that doesn't add up."""
        odd: list[str] = []
        groups = [words_[k : k + width] for k in range(0, len(words_), width)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint16)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or not len(ids) or stops[-1] != len(ids):
                odd += group
                continue
            each.append((group, ids, np.diff(stops, prepend=0)))
        return odd

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has.

        Arrow cuts the texts into chunks, numbers the different ones and looks them up, so that Python sees new chunks only.
        """
        if len(self.names) > MEMORY:
            self._forget()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        plain = pc.match_substring_regex(texts, _PLAIN)
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, s)))
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(plain, texts, "")))
        coded = pc.dictionary_encode(lists.flatten())
        index, every = coded.indices.to_numpy(), coded.dictionary
        which = self._known(every).astype(np.int64)
        new = which < 0
        if new.any():
            which[new] = self._add(every.filter(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        self.uses[which] += np.bincount(index, minlength=len(every)).astype(np.int32)
        ids, lens = self._gather(which[index])
        total, bounds = np.concatenate(([0], np.cumsum(lens, dtype=np.int64))), lists.offsets.to_numpy()
        per = np.diff(total[bounds - bounds[0]])
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()
        if odd:
            pieces = np.split(ids, np.cumsum(per)[:-1])
            for i in odd:
                pieces[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16)
                per[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, per


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of each text and the end id, as little-endian 16-bit numbers."""

    def run(batches):
        own = encoder(path)
        for b in slices(batches, 1, SLICE):
            ids, per = own.encode(pc.fill_null(b.column(1), ""))
            stops = np.cumsum(per)
            raw = np.insert(ids, stops, end_id).astype("<u2", copy=False).tobytes()
            bounds = np.concatenate(([0], 2 * (stops + np.arange(1, len(per) + 1)))).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "ids"])
        own.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def counts(coded: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends one row an id at most."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in slices(batches, 0):
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the coder


def quantise(count: np.ndarray) -> np.ndarray:
    """Counts to frequencies that sum to 2**SCALE, none of an id that occurs below 1."""
    used = count > 0
    freq = np.zeros(len(count), np.int64)
    if not used.any():
        return freq
    room = (1 << SCALE) - int(used.sum())
    freq[used] = 1 + (count[used].astype(np.float64) / count.sum() * room).astype(np.int64)
    freq[np.argmax(freq)] += (1 << SCALE) - freq.sum()
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint16)
        self.filler = int(np.argmax(freq))


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Ids to independent blocks; the last one is filled up with the commonest id."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, table.filler, np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(n, STEPS, LANES)
    state = np.full((n, LANES), LOW, np.uint64)
    word = np.zeros((n, STEPS, LANES), np.uint32)
    sent = np.zeros((n, STEPS, LANES), bool)
    marks = np.zeros((n, STEPS // EVERY, LANES), np.uint64)
    limit = np.uint64(63 - SCALE)
    for t in range(STEPS - 1, -1, -1):
        f, c = table.freq[grid[:, t]], table.base[grid[:, t]]
        out = state >= f << limit
        word[:, t][out] = (state[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        sent[:, t] = out
        state = np.where(out, state >> np.uint64(32), state)
        q = state // f
        state = (q << np.uint64(SCALE)) + (state - q * f) + c
        if t % EVERY == 0:
            marks[:, t // EVERY] = state
    blocks = []
    for k in range(n):
        words = word[k][sent[k]]
        before = np.concatenate(([0], np.cumsum(sent[k].sum(axis=1))))[:-1][::EVERY].astype("<u4")
        body = struct.pack("<I", len(words)) + before.tobytes() + marks[k].astype("<u8").tobytes() + words.astype("<u4").tobytes()
        blocks.append(struct.pack("<I", zlib.crc32(body)) + body)
    return blocks


def decode_blocks(blocks: list[bytes], n_symbols: int, table: Table) -> np.ndarray:
    """The ids of a run of blocks; every checkpoint of every block is decoded side by side."""
    per, head = STEPS // EVERY, []
    states, places, streams, base = [], [], [], 0
    for raw in blocks:
        (crc, size) = struct.unpack_from("<II", raw)
        if zlib.crc32(raw[4:]) != crc:
            raise ValueError("a block's checksum is wrong")
        head.append(size)
        places.append(np.frombuffer(raw, "<u4", per, 8).astype(np.int64) + base)
        states.append(np.frombuffer(raw, "<u8", per * LANES, 8 + 4 * per).reshape(per, LANES))
        streams.append(np.frombuffer(raw, "<u4", size, 8 + 4 * per + 8 * per * LANES))
        base += size
    if not blocks:
        return np.empty(0, np.uint16)
    state, place, stream = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate([*streams, np.zeros(LANES, "<u4")]).astype(np.uint64)
    out = np.empty((len(place), EVERY, LANES), np.uint16)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(EVERY):
        slot = state & mask
        sym = table.symbol[slot.astype(np.int64)]
        out[:, t] = sym
        state = table.freq[sym] * (state >> np.uint64(SCALE)) + slot - table.base[sym]
        need = state < LOW
        ahead = np.cumsum(need, axis=1)
        row, lane = np.nonzero(need)
        state[row, lane] = (state[row, lane] << np.uint64(32)) | stream[place[row] + ahead[row, lane] - 1]
        place = place + ahead[:, -1]
    return out.reshape(-1)[:n_symbols]


MAGIC = b"RNS2"


def file_image(doc_ids: list[int | None], per: np.ndarray, ids: np.ndarray, table: Table, part: int = 0, seq: int = 0) -> bytes:
    blocks = encode_blocks(ids, table)
    body = struct.pack("<QQQII", len(doc_ids), len(ids), len(blocks), part, seq)
    body += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + per.astype("<u4").tobytes()
    body += np.array([len(b) for b in blocks], "<u4").tobytes() + b"".join(blocks)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def open_image(raw: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, symbols per document, all ids."""
    if raw[:4] != MAGIC or zlib.crc32(raw[8:]) != struct.unpack_from("<I", raw, 4)[0]:
        raise ValueError("not a file of this format, or damaged")
    n_docs, n_symbols, n_blocks = struct.unpack_from("<QQQ", raw, 8)
    at = 40
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at).tolist()
    null = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    per = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    sizes = np.frombuffer(raw, "<u4", n_blocks, at).tolist()
    at += 4 * n_blocks
    blocks = []
    for size in sizes:
        blocks.append(raw[at : at + size])
        at += size
    return [None if z else d for d, z in zip(doc_ids, null.tolist(), strict=True)], per, decode_blocks(blocks, n_symbols, table)


# ---------------------------------------------------------------- corpora


def write_files(images: DataFrame, path: str) -> None:
    """A column of bytes to files of their own: the text sink writes bytes as they are, and a line's end behind them."""
    images.select(F.col(images.columns[0]).cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_files(spark, path: str) -> DataFrame:
    """The files of a folder as one column of bytes, image, without the line's end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 1")
    return files.select(F.expr("substring(content, 1, int(length) - 1)").alias("image"))


def write_corpus(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Tokenise, count, and write all documents in ascending doc_id order."""
    spark = docs.sparkSession
    staged = scratch_path(spark, "tokens")
    with modest_batches(spark):
        tokens(docs, tokenizer, end_id).write.parquet(staged)
    coded = spark.read.parquet(staged)
    # one row an id, at most as many as the vocabulary has
    count = np.zeros(1 << 16, np.int64)
    for r in counts(coded).collect():
        count[r["id"]] = r["n"]
    freq = quantise(count)
    write_files(spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "table binary"), f"{path}/frequencies")

    def run(batches):
        from pyspark import TaskContext

        table, part, seq = Table(freq), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        raws: list[bytes] = []
        held = 0

        def flush():
            per = np.array([len(r) // 2 for r in raws], np.int64)
            return pa.RecordBatch.from_pydict({"image": [file_image(ids, per, np.frombuffer(b"".join(raws), "<u2"), table, part, seq)]}, schema=shape)

        shape = pa.schema([("image", pa.binary())])
        for b in slices(batches, 1):
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                raws.append(raw)
                held += len(raw) // 2
                if held >= SHARD:
                    yield flush()
                    ids, raws, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    # rows without an id, and rows that are the same, may be very many: the hash and the row's place deal them over ranges too
    order = (F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("place").asc())
    by = coded.withColumns({"h": F.xxhash64("ids"), "place": F.monotonically_increasing_id()}).repartitionByRange(_ranges(coded), *order).sortWithinPartitions(*order)
    with modest_batches(spark):
        write_files(by.select("doc_id", "ids").mapInArrow(run, "image binary"), f"{path}/shards")
    forget(spark, staged)


def _ranges(coded: DataFrame) -> int:
    total = coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    return max(1, -(-total // (2 * 4 * SHARD)))


def read_corpus(spark, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens) and the ids (16-bit numbers), or their crc32 as 32-bit numbers with digest.

    start is the number of ids of all documents before it.
    """
    files = read_files(spark, f"{path}/shards")
    freq = np.frombuffer(bytes(read_files(spark, f"{path}/frequencies").first()["image"]), "<u4").astype(np.int64)
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.binary(), "binary")
    shape = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), last[:2]])

    def run(batches):
        table = Table(freq)
        for b in slices(batches, 0, 1):  # an image at a time
            for raw in b.column(0).to_pylist():
                part, seq = struct.unpack_from("<II", raw, 32)
                doc_ids, per, ids = open_image(raw, table)
                ends, n = np.cumsum(per), len(doc_ids)
                data = ids.astype("<u4" if digest else "<u2").tobytes()
                bounds = np.concatenate(([0], len(data) // max(1, len(ids)) * ends)).tolist()
                each = [data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
                what = pa.array([zlib.crc32(x) for x in each] if digest else each, last[1])
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - per, pa.int64()), pa.array(per, pa.int64()), what], schema=shape)

    rows = files.mapInArrow(run, f"part int, seq int, doc_id long, within long, n_tokens long, {last[0]} {last[2]}")
    if digest:
        rows = materialise(rows, "token-rows")
        heads = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    else:
        heads = files.select(_number(F.col("image"), 33, 4).alias("part"), _number(F.col("image"), 37, 4).alias("seq"), _number(F.col("image"), 17, 8).alias("n"))
    heads = materialise(heads, "token-heads")
    # symbols before a file within its part, and before a part (one row each)
    parts_ = heads.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts_.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = heads.withColumn("own", own).join(before, "part").select(F.col("part").cast("int"), F.col("seq").cast("int"), (F.col("own") + F.col("before")).alias("base"))
    return rows.join(small(materialise(bases, "token-bases")), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last[0])


def _number(raw: Column, at: int, size: int) -> Column:
    """A little-endian number in bytes, from a position that counts from 1."""
    digits = F.hex(F.substring(raw, at, size))
    turned = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("long")


def op8_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = scratch_path(docs.sparkSession, "token-files")
    write_corpus(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return read_corpus(docs.sparkSession, path, digest=True)


def stage(docs: DataFrame) -> DataFrame:
    return op8_query(docs)
