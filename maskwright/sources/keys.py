"""Keys that no plan shows: a key is a file, read by the query itself, and stands in expressions as a subquery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block of SHA-256.
_BLOCK = 64


def _masked(key: Column, mask: int) -> Column:
    """The key's block, each byte combined with a mask."""
    at = F.sequence(F.lit(1), F.lit(_BLOCK))
    byte = lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("int")
    return F.unhex(F.array_join(F.transform(at, lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(mask))), 2, "0")), ""))


@dataclass(frozen=True)
class Key:
    """A secret in a file that the driver and all executors can read; its bytes are the key. Plans, the UI, event logs and
    error texts name the file, and not what is in it.
    """

    spark: SparkSession
    path: str

    def _rows(self) -> DataFrame:
        return self.spark.read.format("binaryFile").load(self.path).select("content")

    def content(self) -> Column:
        """The bytes, as for AES."""
        return self._rows().scalar()

    def hmac(self, message: Column) -> Column:
        """The lower-case hexadecimal HMAC-SHA-256 (RFC 2104) of a binary or text column."""
        long = F.octet_length("content") > _BLOCK
        short = F.when(long, F.unhex(F.sha2("content", 256))).otherwise(F.col("content"))
        block = F.unhex(F.rpad(F.hex(short), 2 * _BLOCK, "0"))
        pads = self._rows().select(block.alias("key"))
        inner, outer = (pads.select(_masked(F.col("key"), mask)).scalar() for mask in (0x36, 0x5C))
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


__all__ = ["Key"]
