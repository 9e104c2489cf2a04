"""Token ids in Parquet: a list column per document, with page indexes.

Documents are dealt by ranges of doc_id, so that file after file and row after row
the ids stand in ascending doc_id order.  A row holds doc_id, n_tokens, n_bytes and
the list of ids; the writer is Parquet's second, which stores whole numbers without a
dictionary as packed deltas and puts an index over every page.  Readers of metadata
touch the small columns only, readers of some documents only pages in their range.

Splitting into words is what a byte-level tokenizer spends most of its time on.
Texts made of plain letters and single spaces are therefore split by their bytes, many
texts at once: Arrow numbers the distinct pieces, the library's vocabulary encodes each
of these once for a worker, and the lists are dealt back by number.  Any other text
goes through the library whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, staged, staged_path, text_or_empty

#: Appended to every document.
END = 2
#: Bytes of a row group and of a page, which is what the page index tells apart.
ROW_GROUP = 16 << 20
PAGE = 256 << 10
#: Pieces that a worker remembers: the first ones it meets, among which the frequent ones are.
KNOWN = 150_000
#: Bytes of text that are split at once.
STEP = 4 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[{_LETTERS}0-9\n!-/:-@\[-`{{-~ ]*")
_BLANK, _LINE, _LETTER, _DIGIT, _SIGN = range(5)


def _kinds() -> np.ndarray:
    """What each byte of a plain text is; bytes beyond ASCII belong to letters there."""
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[ord(" ")], kinds[ord("\n")] = _BLANK, _LINE
    for low, high in ("AZ", "az"):
        kinds[ord(low) : ord(high) + 1] = _LETTER
    kinds[128:] = _LETTER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    return kinds


_KINDS = _kinds()


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: as themselves where they can be seen, the others from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _plain(text: str) -> bool:
    """Whether a text is of plain letters, signs, line ends and single blanks between other characters."""
    if "  " in text or " \n" in text or "\n " in text or text.endswith(" "):
        return False
    return text.replace("\n", "").isprintable() if text.isascii() else _PLAIN.fullmatch(text) is not None


def piece_starts(octets: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pieces start in plain texts put end to end; texts are the starts of the texts.

    A piece is a run of letters, digits or signs with the blank before it, a run of line ends, or
    after letters, digits or a line end an apostrophe with s, t, re, ve, m, ll or d.
    """
    n = len(octets)
    kind = _KINDS[octets]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
    start |= kind == _BLANK
    first = np.zeros(n + 1, bool)
    first[texts], first[n] = True, True
    start |= first[:n]
    # Of several line ends before something else the last one stands alone.
    line = np.flatnonzero(kind == _LINE)
    line = line[(line > 0) & (line < n - 1)]
    line = line[(kind[line - 1] == _LINE) & (kind[line + 1] != _LINE) & ~first[line + 1]]
    start[line] = True
    for i in np.flatnonzero((octets == ord("'")) & start).tolist():
        tail = bytes(octets[i + 1 : i + 3])
        ended = first[i + 1 : i + 3].tolist()
        long = tail in (b"re", b"ve", b"ll") and not any(ended)
        if long or (tail[:1] in (b"s", b"t", b"m", b"d") and not ended[0]):
            start[i + 1] = False
            if i + 2 + long < n:
                start[i + 2 + long] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by one tokenizer file; a Python worker keeps one for each file."""

    _made: dict = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        before = self.whole.pre_tokenizer
        # Splitting by bytes is right for the plain byte-level kind only.
        self.splits = isinstance(before, ByteLevel) and self.whole.normalizer is None and not before.add_prefix_space and before.use_regex
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(self.known) < KNOWN:
                self.known[piece] = ids
        return ids

    def _plain_lists(self, texts: pa.Array, end: int) -> pa.ListArray:
        """Ids and end of each plain text."""
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        starts = piece_starts(octets, edges[:-1]) if len(octets) else np.zeros(0, np.int64)
        bounds = np.append(starts, len(octets)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(octets)).dictionary_encode()
        lists = _lists([self._piece(p) for p in pieces.dictionary.to_pylist()]).take(pieces.indices)
        first = np.searchsorted(starts, edges)  # the first piece of each text
        ends = lists.offsets.to_numpy()[first]
        values = np.insert(lists.values.to_numpy(), ends[1:], np.int32(end))
        return pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(values))

    def lists(self, texts: pa.Array, end: int) -> pa.ListArray:
        """Ids of each text with the end id after them; texts are not null."""
        strings = texts.to_pylist()
        plain = np.array([self.splits and _plain(t) and not any(s in t for s in self.special) for t in strings], bool)
        if plain.all():
            return self._plain_lists(texts, end)
        tail = np.array([end], "<u4").tobytes()
        other = [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + tail for t, p in zip(strings, plain, strict=True) if not p]
        both = pa.concat_arrays([self._plain_lists(texts.filter(pa.array(plain)), end), _lists(other)])
        place = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
        return both.take(pa.array(place))


_STORE = "doc_id long, n_tokens long, n_chars long, ids array<int>"


def _lists(ids: list[bytes]) -> pa.ListArray:
    values = np.frombuffer(b"".join(ids), "<i4")
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """docs (doc_id, text, ...) -> Parquet files at path, in ascending order of doc_id.

    Null and empty texts give the end id alone.  Null doc_ids come first; rows with one
    doc_id come in the order of a hash of their texts, so a doc_id that many rows
    share is dealt to several files.  Repeated rows are repeated; other columns are
    left out; no rows give an empty store.
    """

    def run(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            edges = np.cumsum(np.r_[0, pc.binary_length(batch.column(1)).to_numpy()])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(edges, edges[low] + STEP, "right")) - 1)
                part = batch.slice(low, high - low)
                ids = encoder.lists(part.column(1), end)
                chars = pc.utf8_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.list_value_length(ids).cast(pa.int64()), chars, ids], ["doc_id", "n_tokens", "n_chars", "ids"]
                )
                low = high

    slim = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    dealt = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        (
            dealt.mapInArrow(run, _STORE)
            .write.option("compression", "zstd")
            .option("parquet.writer.version", "PARQUET_2_0")
            .option("parquet.enable.dictionary", "false")
            .option("parquet.enable.dictionary#ids.list.element", "true")
            .option("parquet.block.size", str(ROW_GROUP))
            .option("parquet.page.size", str(PAGE))
            .parquet(path)
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The store, with the place of each row: file and row number in it."""
    return spark.read.schema(_STORE).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame, store: DataFrame) -> DataFrame:
    """rows (file, row, n_tokens, ...) of a store + start: ids before the row in the whole store.

    Files are added up among themselves (a row for each), from the small columns alone;
    rows are added up only inside their file.
    """
    # Files are numbered by the writer; as names, numbers of six digits would come before those of five.
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = store.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("file_tokens").over(earlier), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(files, "file").withColumn(
        "start", F.col("start") + F.col("file_start")
    )


def crc_of_ids(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_tokens, file, row, ids) -> the same without ids, with ids_crc32."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            offsets = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(memoryview(values[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    return rows.select("doc_id", "n_tokens", "file", "row", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, file string, row long, ids_crc32 long"
    )


def token_digest(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write docs as a token store in the shared folder and describe it from its files."""
    spark = docs.sparkSession
    path = staged_path(spark, "token-store")
    write_tokens(docs, path, tokenizer, end)
    store = read_tokens(spark, path)
    # Small rows, written here so that the lists of ids go to Python in small batches too.
    with small_batches(spark):
        rows = staged(crc_of_ids(store), "token-crcs")
    return with_starts(rows, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
