"""Content fingerprints: of the whole content, or sampled from head and tail."""

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pathledger.functions.paths import _col
from pathledger.schema import HASH_LIMIT
from pathledger.sources.remote import open_for_reading

BLOCK = 1024 * 1024
# Bytes that a quick sample takes from each of start, middle and end, and up to which it is the whole content.
_SAMPLE = 4096
SAMPLED_WHOLE = 3 * _SAMPLE


def smart_hash(content, size):
    """MD5 of a small content; of head, tail and size for 1 MiB and more; NULL above 100 MiB.

    The tail counts only above 2 MiB. Stays in generated JVM code.
    """
    content, size = _col(content), _col(size)
    head = F.substring(content, 1, BLOCK)
    tail = F.when(size > 2 * BLOCK, F.substring(content, -BLOCK, BLOCK)).otherwise(F.lit(b""))
    digits = F.encode(size.cast("string"), "UTF-8")
    return (
        F.when(size > HASH_LIMIT, F.lit(None))
        .when(size < BLOCK, F.md5(content))
        .otherwise(F.md5(F.concat(head, tail, digits)))
    )


def _sampled(size):
    """Byte ranges that the sampled fingerprint covers, and what it adds at the end."""
    if size < BLOCK:
        return [(0, size)], b""
    tail = [(size - BLOCK, BLOCK)] if size > 2 * BLOCK else []
    return [(0, BLOCK), *tail], str(size).encode()


def _digest_at(path, ranges, ending=b""):
    """MD5 over byte ranges of a file, read in blocks; NULL if it cannot be read."""
    digest = hashlib.md5()
    try:
        with open_for_reading(path) as handle:
            for start, length in ranges:
                if start:
                    handle.seek(start)
                while length > 0 and (block := handle.read(int(min(BLOCK, length)))):
                    digest.update(block)
                    length -= len(block)
    except (OSError, pa.ArrowException):
        return None
    digest.update(ending)
    return digest.hexdigest()


@F.pandas_udf(StringType())
def content_md5_at(path: pd.Series) -> pd.Series:
    """MD5 of the whole content of the file at ``path``, of any size; NULL for an unreadable file."""
    return pd.Series([None if p is None else _digest_at(p, [(0, float("inf"))]) for p in path], dtype=object)


@F.pandas_udf(StringType())
def smart_hash_at(path: pd.Series, size: pd.Series) -> pd.Series:
    """``smart_hash`` of the file at ``path``; of a file over 2 MiB only head and tail are read.

    A sample: files that differ in the middle agree, so it is no ``content_hash``. NULL for an
    unreadable file, for a negative size and above the fixed limit.
    """
    sizes = [int(s) for s in size]
    found = [_digest_at(p, *_sampled(s)) if 0 <= s <= HASH_LIMIT else None for p, s in zip(path, sizes)]
    return pd.Series(found, dtype=object)


def _quick(size):
    """Byte ranges of a quick sample; they cover a content of up to SAMPLED_WHOLE bytes."""
    if size <= SAMPLED_WHOLE:
        return [(0, float("inf"))]
    return [(0, _SAMPLE), ((size - _SAMPLE) // 2, _SAMPLE), (size - _SAMPLE, _SAMPLE)]


@F.pandas_udf(StringType())
def sample_md5_at(path: pd.Series, size: pd.Series) -> pd.Series:
    """MD5 of a quick sample of the file at ``path``; NULL for an unreadable file.

    Files of one size that differ in it differ. Of a small file it is the MD5 of the whole content.
    """
    found = [None if p is None else _digest_at(p, _quick(int(s))) for p, s in zip(path, size)]
    return pd.Series(found, dtype=object)
