"""Fill-in-middle transformation over an index of distinct texts.

* Rows meet by the hash of their text, and within a hash identical texts are told by comparing whole contents.
* Of each distinct text the code point boundaries are listed once, as an Elias-Fano list: byte offsets in two parts, the
  low bits as they are and the high bits in unary with a directory, so that the place of any code point is found
  without decoding what comes before.
* The documents of the text are joined back to that list; each selects its own seeded cuts from it.

A text of more than `copies` documents is dealt out over several tasks by salts, each of which lists its boundaries once,
so no task holds the documents of a hot text. Texts are shuffled once, and pass through tasks as streams.

A document of n code points has its prefix end at the smaller of h1 % (n + 1) and h2 % (n + 1) and its middle at the
larger; h1 to h4 are the first four 32-bit groups of sha256("<seed>:<doc_id>"). The form is plain if the text is empty or
holds a marker or h3 % 100 >= 90; otherwise suffix first (spm) if h4 % 100 < 20, else prefix first (psm).

Edge cases: a null text is empty, so plain with no code points; a null id is seeded as the word null; rows that repeat an
id and a text give equal rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_shared

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of one text beyond which it is dealt out over several tasks.
COPIES = 1_000
#: Entries of an Elias-Fano list between two places of its directory.
STRIDE = 256


class EliasFano:
    """An ascending list of numbers up to `top`: about 2 + log2(top / n) bits each, any one read without the others."""

    def __init__(self, values: np.ndarray, top: int):
        self.n = len(values)
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        self.low = np.packbits((values[:, None] >> np.arange(self.low_bits)) & 1, bitorder="little") if self.low_bits else np.zeros(0, np.uint8)
        ones = (values >> self.low_bits) + np.arange(self.n)
        bits = np.zeros((top >> self.low_bits) + self.n + 1, bool)
        bits[ones] = True
        self.high = np.packbits(bits, bitorder="little")
        self.directory = ones[::STRIDE].astype(np.int64)

    def __getitem__(self, i: int) -> int:
        """The i-th number: its one bit in the high part is looked for from the directory's place on."""
        block = i // STRIDE
        at = int(self.directory[block])
        end = int(self.directory[block + 1]) if block + 1 < len(self.directory) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : end // 8 + 1], bitorder="little")[at % 8 :])
        high = at + int(ones[i - block * STRIDE]) - i
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit // 8]) >> bit % 8 & 1) << k
        return high << self.low_bits | low


class IndexedText:
    """A distinct text: its bytes, its code point boundaries and whether it may be cut."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.data = data
        self.bounds = EliasFano(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)), len(raw))
        self.n = self.bounds.n - 1
        self.whole = not data or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE))

    def cut(self, doc_id: int | None, seed: str, plain: int, spm: int) -> tuple[str, int | None, int | None, bytes]:
        """form, prefix_chars, middle_chars, output of one document of this text."""
        digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
        h = [int.from_bytes(digest[at : at + 4], "big") for at in range(0, 16, 4)]
        if self.whole or h[2] % 100 >= 100 - plain:
            return "plain", None, None, self.data
        first, last = sorted((h[0] % (self.n + 1), h[1] % (self.n + 1)))
        a, b = self.bounds[first], self.bounds[last]
        prefix, middle, suffix = self.data[:a], self.data[a:b], self.data[b:]
        if h[3] % 100 < spm:
            return "spm", first, last - first, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
        return "psm", first, last - first, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle


def by_text(docs: DataFrame, copies: int = COPIES) -> DataFrame:
    """(doc_id, text, key, salt): rows of one text (and salt) in one partition, one after another. The texts that more than
    `copies` documents have are counted first, from hashes alone, and written; Spark broadcasts that table where it is small."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    hot = write_shared(rows.groupBy("key").count().where(F.col("count") > copies).select(F.col("key").alias("hot"), F.ceil(F.col("count") / copies).alias("parts")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))
    dealt = rows.join(hot, F.col("key") == F.col("hot"), "left").select("doc_id", "text", "key", salt.alias("salt"))
    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt")


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, copies: int = COPIES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row. plain, spm: percent of the documents that stay
    plain, and of the others that have the suffix first."""

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            ids, texts, keys, salts = (c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3)))
            out = []
            for doc_id, data, key, salt in zip(ids, texts, keys, salts):
                if (key, salt) != at:
                    at, known = (key, salt), {}  # texts of one hash: one, unless hashes collide
                text = known.get(data)  # found by comparing whole contents
                if text is None:
                    text = known[data] = IndexedText(data)
                out.append((text.n, *text.cut(doc_id, seed, plain, spm)))
            n, form, prefix, middle, output = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return by_text(docs, copies).mapInArrow(transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form alone: no text that is cut holds a marker, so the markers split it."""
    part = lambda k: F.split(F.col(output), "<[PSM]>", 4)[k]
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


#: The same cuts for DuckDB, from the text of each row; what is restored is the text itself.
OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, 'null')) as s from documents),
h as (select doc_id, t, length(t)::bigint as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
c as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from c
"""
