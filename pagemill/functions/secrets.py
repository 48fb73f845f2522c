"""Password hashes, keyed seals and name folding, in column expressions; only PBKDF2 and case folding, which have no
built-in, run in Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITERATIONS = 210_000
# The scheme's name and the sealed formats' sizes.
SCHEME = "pbkdf2_sha256"
OLD_NONCE, MAC = 16, 32


@dataclass(frozen=True)
class Labels:
    """What keys are derived for. Seals made elsewhere open with the labels that were used there."""

    seal: bytes = b"key-encryption-v2"
    old_seal: bytes = b"key-encryption-v1"
    old_mac: bytes = b"key-auth-v1"


LABELS = Labels()


def normal_username(c: Column) -> Column:
    """Squeezed and case-folded."""

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.str.split().str.join(" ").str.casefold()

    return fold(c)


def _to_url(c: Column) -> Column:
    return F.translate(F.base64(c), "+/", "-_")


def _from_url(c: Column) -> Column:
    return F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64"))


# ---- passwords ------------------------------------------------------------------------------------


def stretched(password: Column, salt: Column, rounds: Column) -> Column:
    """PBKDF2 with HMAC-SHA-256; null where any part is null."""

    @F.pandas_udf(T.BinaryType())
    def run(p: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        known = p.notna() & s.notna() & n.notna()
        out = pd.Series([None] * len(p), dtype=object)
        out[known] = [hashlib.pbkdf2_hmac("sha256", x.encode(), bytes(y), int(k)) for x, y, k in zip(p[known], s[known], n[known], strict=True)]
        return out

    return run(password, salt, rounds)


def hash_password(password: Column, salt: Column, iterations: int = ITERATIONS) -> Column:
    """scheme$iterations$salt$digest, both in URL-safe base64; salt is binary."""
    digest = stretched(password, salt, F.lit(iterations))
    return F.concat_ws("$", F.lit(SCHEME), F.lit(str(iterations)), _to_url(salt), _to_url(digest))


def verify_password(password: Column, stored: Column) -> Column:
    """False for malformed hashes too."""
    part = lambda i: F.split_part(stored, F.lit("$"), F.lit(i))
    well_formed = F.rlike(stored, F.lit(rf"\A{SCHEME}\$[1-9][0-9]{{0,8}}\$[A-Za-z0-9_=-]*\$[A-Za-z0-9_=-]+\z"))
    rounds = F.when(well_formed, part(2).try_cast("int"))
    return F.coalesce(stretched(password, _from_url(part(3)), rounds) == _from_url(part(4)), F.lit(False))


# ---- seals ----------------------------------------------------------------------------------------


def derive_key(secret: bytes, label: bytes) -> bytes:
    return hmac.new(secret, label, hashlib.sha256).digest()


def keyed_digest(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a binary column, from two hashes of padded keys."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ mask for x in block)) for mask in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def xored(a: Column, b: Column) -> Column:
    """Two binary columns, byte by byte, as long as the first; b is as long at least. In words of four bytes."""
    words = F.ceil(F.length(a) / 4).cast("int")
    word = lambda c, i: F.conv(F.rpad(F.substring(F.hex(c), i * 8 + 1, F.lit(8)), 8, "0"), 16, 10).cast("long")
    mixed = F.transform(F.sequence(F.lit(1), words), lambda i: F.lpad(F.hex(word(a, i - 1).bitwiseXOR(word(b, i - 1))), 8, "0"))
    return F.when(words > 0, F.unhex(F.left(F.array_join(mixed, ""), F.length(a) * 2))).otherwise(F.lit(b""))


def seal(text: Column, secret: bytes, labels: Labels = LABELS) -> Column:
    """"v2", nonce, cipher and tag of AES-GCM, in URL-safe base64."""
    key = F.lit(derive_key(secret, labels.seal)[:32])
    return _to_url(F.concat(F.lit(b"v2"), F.aes_encrypt(F.encode(text, "utf-8"), key, F.lit("GCM"))))


def unseal(sealed: Column, secret: bytes, labels: Labels = LABELS) -> Column:
    """The text of either format; empty where it can't be opened."""
    raw = _from_url(sealed)
    key = F.lit(derive_key(secret, labels.seal)[:32])
    new = F.try_aes_decrypt(F.substring(raw, F.lit(3), F.length(raw)), key, F.lit("GCM")).cast("string")
    version = F.substring(raw, 1, 2).cast("string")
    return F.coalesce(F.when(version == "v2", new).when(version == "v1", _old(raw, secret, labels)), F.lit(""))


def _old(raw: Column, secret: bytes, labels: Labels) -> Column:
    """The older format: "v1", nonce, cipher (text under a stream of keyed digests of nonce and counter) and MAC;
    null where the MAC is wrong or the text is no UTF-8."""
    size = F.length(raw) - 2 - OLD_NONCE - MAC
    nonce, cipher = F.substring(raw, 3, OLD_NONCE), F.substring(raw, F.lit(3 + OLD_NONCE), size)
    counters = F.sequence(F.lit(0), F.greatest(F.ceil(size / 32).cast("int") - 1, F.lit(0)))
    counter = lambda i: F.unhex(F.lpad(F.hex(i), 16, "0"))
    digests = F.transform(counters, lambda i: F.hex(keyed_digest(derive_key(secret, labels.old_seal), F.concat(nonce, counter(i)))))
    good = F.substring(raw, -MAC, MAC) == keyed_digest(derive_key(secret, labels.old_mac), F.substring(raw, F.lit(1), F.length(raw) - MAC))
    plain = xored(cipher, F.unhex(F.array_join(digests, ""))).cast("string")
    return F.when((size >= 0) & good & F.is_valid_utf8(plain), plain)
