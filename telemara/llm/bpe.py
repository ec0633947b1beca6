"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Texts longer than this are cut at safe boundaries before they are encoded.
LONG = 16_384
#: What the pattern's \\s matches.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places that no match of the pattern spans and no lookahead sees across: before white space; before the last of
#: several white-space characters, if something else follows; between a letter or digit and these marks.
SAFE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])|(?<=[{BLANK}])(?=[{BLANK}][^{BLANK}])|(?<=[^\\W_])(?=[!-/:-@\\[-`{{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: White space so long that the pattern's matching of it must not be left to the library, which counts its steps on a stack.
RUN = re.compile(f"[{BLANK}]{{1000,}}")


@functools.lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, most: int = LONG):
    """(piece, whole) in order: text cut at the first safe place after each `most` characters.

    A long run of white space is a piece that is one match of the pattern as a whole, but for its last character,
    which may begin the next match. A text without safe places stays in one piece.
    """
    start = 0
    while len(text) - start > most:
        run, cut = RUN.search(text, start, start + most + 1000), SAFE.search(text, start + most)
        if run is not None:
            run = RUN.match(text, run.start())  # the search ends early, the run need not
            end = run.end() - (run.end() < len(text))
            if run.start() > start:
                yield text[start : run.start()], False
            yield text[run.start() : end], True
            start = end
        elif cut is None:
            break
        else:
            yield text[start : cut.start()], False
            start = cut.start()
    if start < len(text) or not text:
        yield text[start:], False


def encode_text(enc: tiktoken.Encoding, text: str | None, most: int = LONG) -> np.ndarray:
    ids = [i for piece, whole in pieces(text or "", most) for i in (enc._encode_single_piece(piece.encode()) if whole else enc.encode_ordinary(piece))]
    return np.array(ids, dtype="<u4")


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


#: Bytes of text or ids that a task turns at a time.
AT_A_TIME = 4_000_000


def _coded(texts: pa.Array, enc: tiktoken.Encoding) -> pa.Array:
    return _binary([encode_text(enc, t.as_py()).tobytes() for t in texts])


def _decoded(coded: pa.Array, enc: tiktoken.Encoding) -> pa.Array:
    return _binary([enc.decode_bytes(np.frombuffer(x.as_py(), dtype="<u4").tolist()) if x.is_valid else None for x in coded])


def _mapped(source: DataFrame, at: int, ranks_path: str, pattern: str, made: dict, dropped: bool) -> DataFrame:
    """source plus the columns of `made`, each a function of the one before it, the first of column number `at`, which
    goes if `dropped`. One pass; the rank file is read by the driver and sent along (its size is that of one vocabulary).
    """
    with open(ranks_path, "rb") as f:
        ranks = source.sparkSession.sparkContext.broadcast(f.read())
    kept = [i for i in range(len(source.columns)) if not (dropped and i == at)]
    schema = source.select(*[F.col(f"`{source.columns[i]}`") for i in kept], *[F.lit(None).cast("binary").alias(k) for k in made]).schema

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            column = batch.column(at)
            for i, j in slices([len(x.as_buffer()) if x.is_valid else 0 for x in column], AT_A_TIME):
                last, columns = column[i:j], []
                for turn in made.values():
                    last = turn(last, enc)
                    columns.append(last)
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i:j] for k in kept], *columns], names=[*[batch.schema.names[k] for k in kept], *made])

    return source.mapInArrow(run, schema)


def _with_text_last(df: DataFrame, text: str, *made: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (text, *made)], F.col(f"`{text}`").alias(made[0]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df without its text, plus `out`: the token ids as little-endian unsigned 32-bit integers.

    Null and empty texts give empty ids. A column of df already named `out` is replaced.
    """
    source = _with_text_last(df, text, out)
    return _mapped(source, len(source.columns) - 1, ranks_path, pattern, {out: _coded}, True)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df plus `out`: the bytes that the ids stand for; null ids give null. Bytes need not be valid UTF-8."""
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    return _mapped(source, source.columns.index(ids), ranks_path, pattern, {out: _decoded}, False)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """decode(encode(df)) in one pass, so that a task needs one Python worker and ids are not sent to and fro."""
    source = _with_text_last(df, text, ids, out)
    return _mapped(source, len(source.columns) - 1, ranks_path, pattern, {ids: _coded, out: _decoded}, True)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, plus n_tokens and the digests of the ids and of the bytes they decode to.

    Null and empty texts have no token and the digests of nothing; repeated rows give equal rows; very long texts are
    cut where no token can span; columns of df named as the new ones are replaced, all others stay.
    """
    coded = encode_decode(df, ranks_path, pattern, text)
    made = {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    keep = [c for c in df.columns if c not in (text, "ids", "decoded", *made)]
    return coded.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in made.items()])
