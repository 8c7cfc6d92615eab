"""AES in cipher feedback mode with a zero initialisation vector, as Column expressions over Spark's own AES of single blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.scalars import _let as let

_BLOCK = 32  # hexadecimal digits of a block
_ZERO = "0" * _BLOCK


def _cipher(block: Column, key: Column) -> Column:
    """A block under AES; Spark pads the input, which only adds a block after the one that counts."""
    return F.substring(F.hex(F.aes_encrypt(F.unhex(block), key, F.lit("ECB"), F.lit("PKCS"))), 1, _BLOCK)


def _xor(a: Column, b: Column) -> Column:
    """Exclusive or of two strings of hexadecimal digits, as long as the first."""
    padded = F.rpad(a, _BLOCK, "0")
    number = lambda x, i: F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("bigint")
    parts = [F.lpad(F.hex(number(padded, i).bitwiseXOR(number(b, i))), 8, "0") for i in range(4)]
    return F.substr(F.concat(*parts), F.lit(1), F.length(a))


def _stream(block: Column, before: Column, key: Column) -> Column:
    """A block met with the cipher of the one before it, which is made once: inside a lambda Spark finds no common parts."""
    return let(_cipher(before, key), lambda c: _xor(block, c))


def _blocks(data: Column) -> Column:
    return F.regexp_extract_all(F.hex(data), F.lit(".{1,%d}" % _BLOCK), F.lit(0))


def encrypt(data: Column, key_hex: str | Column) -> Column:
    """Binary data under a key of 16, 24 or 32 bytes, given in hexadecimal; each block depends on the one before. Null stays null."""
    key = F.unhex(F.lit(key_hex) if isinstance(key_hex, str) else key_hex)
    start = F.struct(F.lit(_ZERO).alias("last"), F.lit("").alias("out"))

    def step(state, block):
        return let(_stream(block, state["last"], key), lambda made: F.struct(made.alias("last"), F.concat(state["out"], made).alias("out")))

    return F.when(data.isNotNull(), F.unhex(F.aggregate(_blocks(data), start, step)["out"]))


def decrypt(data: Column, key_hex: str | Column) -> Column:
    """What :func:`encrypt` made of it; the blocks don't depend on each other."""
    key = F.unhex(F.lit(key_hex) if isinstance(key_hex, str) else key_hex)

    def plain(blocks):
        before = F.concat(F.array(F.lit(_ZERO)), F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))))
        return F.array_join(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, p: _stream(b, p, key)), "")

    return F.when(data.isNotNull(), F.unhex(let(_blocks(data), plain)))
