"""Digests, hash vectors and the change level between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
RECORD = "\x1e"
MERSENNE_31 = 2147483647


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def token_hash(tokens: Column) -> Column:
    """tokens: array<struct<type, text>>."""
    return sha(F.array_join(F.transform(tokens, lambda t: F.concat(t["type"], F.lit(UNIT), t["text"])), RECORD))


def alpha_tokens(tokens: Column, bindings: Column, identifiers: tuple[str, ...], preserved: tuple[str, ...] = (), self_name: Column | None = None) -> Column:
    """Identifier tokens that name a local binding become $ and the number of the binding; with self_name, that name becomes $self.
    Preserved types stay as they are."""

    def renamed(t: Column) -> Column:
        at = F.array_position(bindings, t["text"])
        text = F.when(at > 0, F.concat(F.lit("$"), (at - 1).cast("string")))
        if self_name is not None:
            text = F.when(t["text"] == self_name, F.lit("$self")).otherwise(text)
        free = t["type"].isin(*identifiers) & ~t["type"].isin(*(preserved or ("",)))
        return F.struct(t["type"].alias("type"), F.when(free, F.coalesce(text, t["text"])).otherwise(t["text"]).alias("text"))

    return F.transform(tokens, renamed)


def change_level(prev: dict[str, Column], next: dict[str, Column]) -> Column:
    """The first layer in which two hash vectors differ; other profiles can't be compared and count as shape."""
    same = {k: prev[k] == next[k] for k in ("profile", "raw", "token", "alpha", "shape")}
    return F.when(~same["profile"], "shape").when(same["raw"], "none").when(same["token"], "raw").when(same["alpha"], "token").when(same["shape"], "alpha").otherwise("shape")


def stable_key(birth_sha: Column, path: Column, symbol: Column, disambiguator: Column | None = None) -> Column:
    last = F.coalesce(disambiguator, F.lit("")) if disambiguator is not None else F.lit("")
    return sha(F.concat_ws("\0", birth_sha, path, symbol, last))


def content_key(*fields: Column) -> Column:
    return sha(F.concat_ws(UNIT, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def quote_id(text: Column, sha_: Column, kind: Column) -> Column:
    return F.substring(sha(F.concat_ws("\0", text, sha_, kind)), 1, 16)


def hash32(value: Column) -> Column:
    """The first four bytes of SHA-1 as a number, modulo 2**31 - 1."""
    return F.pmod(F.conv(F.substring(F.sha1(value), 1, 8), 16, 10).cast("bigint"), F.lit(MERSENNE_31))
