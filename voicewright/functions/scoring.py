"""Agreement of two transcripts: normalisation, edit distance, disagreement and weight, as column expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Code points that NFC never changes and that never join the one before: Latin, punctuation, kana, Han, Hangul syllables.
COMPOSED = ((0x0000, 0x02FF), (0x2002, 0x20CF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` computed once, however often they're read: what a generator gives isn't put into later expressions again, as a plain column is."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def nfc(text: Column) -> Column:
    """Unicode NFC. Texts of composed characters alone need none; Spark has no such function, so other texts take one Arrow call, and only these are sent."""

    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC") if s.notna().any() else s

    # Texts of one byte a character need no search.
    loose = (F.octet_length(text) != F.length(text)) & text.rlike("[^" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in COMPOSED) + "]")
    return F.when(loose, F.pandas_udf(composed, StringType())(F.when(loose, text))).otherwise(text)


def packed(digest: Column) -> Column:
    """A SHA-256 digest in lower-case hex as its 32 bytes, any other text as its own bytes behind 33 zeros: half the size on disk and in a shuffle, and nothing is lost."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.unhex(digest)).otherwise(F.concat(F.lit(bytes(33)), digest.cast("binary")))


def unpacked(digest: Column) -> Column:
    """The text of ``packed``."""
    return F.when(F.length(digest) == 32, F.lower(F.hex(digest))).otherwise(F.substring(digest, 34, 2**31 - 1).cast("string"))


def normalize_for_scoring(text: Column) -> Column:
    """Drop white space, punctuation, symbols and controls; case, letters, marks and numbers stay."""
    return F.regexp_replace(nfc(text), r"[\p{Z}\p{P}\p{S}\p{C}]", "")


def distance(a: str, b: str) -> int:
    """Edits of code points between two texts: a column of the table as one integer's bits, so a long pair costs its area over the machine's word (Myers 1999, Hyyro 2003)."""
    if len(a) > len(b):
        a, b = b, a
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    a, b = a[n:], b[n:]
    n = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(a))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = full, 0
    for y in b:
        same = where.get(y, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up, fall = less | (full & ~(across | more)), more & across
        if up & top:
            score += 1
        elif fall & top:
            score -= 1
        up = (up << 1 | 1) & full
        more, less = (fall << 1 & full) | (full & ~(down | up)), up & down
    return score


def edit_distance(a: Column, b: Column) -> Column:
    """``distance`` of two columns in Arrow batches; Spark's own takes a step for each pair of characters. Null where either is null."""

    @F.arrow_udf("long")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(xs.to_pylist(), ys.to_pylist())], pa.int64())

    return run(a, b)


def disagreement(primary: Column, secondary: Column) -> Column:
    """Code point edits over the primary's length, of normalised texts; may exceed 1. Equal and empty texts skip the distance."""
    told = (primary != secondary) & (F.length(secondary) > 0) & (F.length(primary) > 0)
    edits = F.when(primary == secondary, 0).when(F.length(secondary) == 0, F.length(primary)).when(F.length(primary) == 0, F.length(secondary)).otherwise(edit_distance(F.when(told, primary), F.when(told, secondary)))
    return edits / F.greatest(F.length(primary), F.lit(1))


def reliability_weight(d: Column, gamma: float = 3.0, w_min: float = 0.1) -> Column:
    """max(w_min, (1 - min(d, 1)) ** gamma); the floor comes after the power."""
    if not (gamma > 0 and 0 < w_min <= 1):
        raise ValueError("gamma must be positive and w_min in (0, 1]")
    return F.greatest(F.lit(float(w_min)), F.pow(1 - F.least(d, F.lit(1.0)), F.lit(float(gamma))))


def u64_of(text: Column) -> Column:
    """First eight bytes of the SHA-256 digest as an unsigned integer, in a decimal."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def digest_mod(text: Column, n: Column) -> Column:
    """The 256-bit SHA-256 digest modulo ``n``; null where either is null. Whole Arrow batches: expressions have no integers of that width."""

    @F.arrow_udf("long")
    def folded(texts: pa.Array, ns: pa.Array) -> pa.Array:
        out = [None if t is None or m is None else int.from_bytes(hashlib.sha256(t.encode()).digest()) % m for t, m in zip(texts.to_pylist(), ns.to_pylist())]
        return pa.array(out, pa.int64())

    return folded(text, n.cast("long"))
