"""Token counts of documents in flat, unindexed token files, by a block-wise separator scan.

A token file holds 16-bit little-endian ids and an end-of-document id after each document, nothing else.
Each file is cut into blocks that are searched at once, with one vector comparison a block. A document that
crosses blocks is stitched by a prefix scan over the blocks: the start that a block hands on is the last start
known before it, an associative "last that is not null". Beyond its own tokens a block needs the few after it that lead
its last document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import built, vocabulary
from .common import keyed_text, released, shared_folder

#: Tokens of a block (2 MB).
BLOCK_TOKENS = 1 << 20
#: Bytes of a token file that is written; a longer document has a file of its own.
FILE_BYTES = 64 << 20
#: Leading tokens of a document that hold its integer id, in digits of base 2**15, lowest first.
ID_TOKENS, ID_BITS = 5, 15


def id_tokens(ids: np.ndarray) -> np.ndarray:
    """(n, ID_TOKENS) digits of ids; the last token has their 4 highest bits, so that negative ids fit."""
    v = ids.astype(np.int64).view(np.uint64)
    return np.stack([(v >> np.uint64(ID_BITS * i)) & np.uint64((1 << ID_BITS) - 1) for i in range(ID_TOKENS)], 1).astype("<u2")


def ids_of(digits: np.ndarray) -> np.ndarray:
    v = np.zeros(len(digits), np.uint64)
    for i in range(ID_TOKENS):
        v |= digits[:, i].astype(np.uint64) << np.uint64(ID_BITS * i)
    return v.view(np.int64)


def write_token_files(docs: DataFrame, path: str, vocab_path: str | None = None, *, separator: int = 49407, file_bytes: int = FILE_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Writes each document as id tokens, its text's BPE ids and the separator; a file has at most file_bytes, or one document.

    Strings of special tokens are ordinary text here, so that no document holds the separator. Null texts are
    empty documents; rows without a key are left out by callers (a null key can't be written as tokens).
    """
    if not 1 << ID_BITS <= separator < 1 << 16:
        raise ValueError("the separator must be above the digits of the id tokens and have 16 bits")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, end = built(shared.value, False), np.array([separator], "<u2").tobytes()
        held, size = [], 0
        for batch in released(batches, "codecs"):
            heads = id_tokens(batch[key].to_numpy(np.int64))
            for head, x in zip(heads, batch[text], strict=True):
                tokens = head.tobytes() + codec.encode(x)
                if held and size + len(tokens) + 2 > file_bytes:
                    yield pd.DataFrame({"tokens": [end.join(held)]})
                    held, size = [], 0
                held.append(tokens)
                size += len(tokens) + 2
        if held:
            yield pd.DataFrame({"tokens": [end.join(held)]})

    rows = keyed_text(docs.filter(F.col(key).isNotNull()), key, text).withColumn(key, F.col(key).cast("long"))
    last = bytes((separator & 255, separator >> 8)).decode("latin-1")
    # A row is a whole file less its last separator.
    files = rows.mapInPandas(work, "tokens binary").select(F.col("tokens").cast("string").alias("value"))
    files.write.option("lineSep", last).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def scan_token_files(spark, path: str, *, separator: int = 49407, lead: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, start, n_tokens, closed, lead): every document of the token files under path.

    start: token offset in the file; n_tokens: without separator and lead tokens; lead: its first `lead` tokens,
    as bytes; closed: whether a separator follows. Two adjacent separators hold an empty document; tokens after
    the last separator are an open one. A file of an odd number of bytes raises an error. A task reads a file, of at
    most 2 GB, Spark's bound for a binary value; the prefix scan moves one row a block and the documents' positions,
    never tokens.
    """

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) % 2:
                    raise ValueError(f"{name}: not a file of 16-bit tokens")
                tokens = np.frombuffer(content, "<u2")
                for block, begin in enumerate(range(0, len(tokens), block_tokens)):
                    part = tokens[begin : begin + block_tokens]
                    ends = np.flatnonzero(part == separator) + begin
                    starts = ends + 1
                    if not block:
                        starts = np.concatenate([[0], starts])
                    starts = starts[starts < len(tokens)]  # what follows the file's last separator is no document
                    heads = [tokens[s : s + lead].tobytes() for s in starts.tolist()]
                    # Starts before the block's first separator belong to it; the others end at the next separator.
                    yield pd.DataFrame({"file": [name], "block": [block], "begin": [begin], "size": [len(part)], "last_block": [begin + len(part) == len(tokens)], "starts": [starts], "leads": [heads], "ends": [ends]})

    schema = "file string, block int, begin long, size long, last_block boolean, starts array<long>, leads array<binary>, ends array<long>"
    blocks = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, schema)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = lambda c: F.last(F.when(F.size("starts") > 0, F.element_at(c, -1)), ignorenulls=True).over(before)
    scanned = blocks.withColumns({"in_start": handed("starts"), "in_lead": handed("leads")})
    # In a block, the k-th document to end is the one handed in, if the block's first start is its own only after an end.
    own = F.when(F.col("block") == 0, F.col("starts")).otherwise(F.concat(F.array("in_start"), F.col("starts")))
    own_leads = F.when(F.col("block") == 0, F.col("leads")).otherwise(F.concat(F.array("in_lead"), F.col("leads")))
    ends = F.when(F.col("last_block") & (F.size("own") > F.size("ends")), F.concat(F.col("ends"), F.array(F.col("begin") + F.col("size")))).otherwise(F.col("ends"))
    zipped = scanned.withColumns({"own": own, "own_leads": own_leads, "n_ends": F.size("ends")}).withColumn("ends", ends)
    docs = zipped.select("file", "n_ends", F.slice("own", 1, F.size("ends")).alias("own"), F.slice("own_leads", 1, F.size("ends")).alias("own_leads"), "ends")
    each = docs.select("file", "n_ends", F.posexplode(F.arrays_zip("own", "own_leads", "ends")).alias("i", "d"))
    n = F.col("d.ends") - F.col("d.own")
    return each.filter("d.own IS NOT NULL").select("file", F.col("d.own").alias("start"), F.greatest(n - lead, F.lit(0).cast("long")).alias("n_tokens"), (F.col("i") < F.col("n_ends")).alias("closed"), F.col("d.own_leads").alias("lead"))


def document_token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, vocab_path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every document with a key, counted in the token files that its table is written to."""
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    write_token_files(docs, path, vocab_path, key=key, text=text)
    found = scan_token_files(spark, path, lead=ID_TOKENS)

    def keys(lead: pd.Series) -> pd.Series:
        return pd.Series(ids_of(np.frombuffer(b"".join(lead), "<u2").reshape(len(lead), ID_TOKENS)))

    return found.select(F.pandas_udf(keys, "long")("lead").alias(key), "n_tokens")
