"""Column expressions on unsigned 32-bit values: bands, quantization, bit errors, sizes of encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavemill.schema import U32
from wavemill.tuning import CLASSES, BandTuning


def quantize_mask(qbits: int) -> int:
    """All of the 32 bits but the ``qbits`` lowest."""
    return (U32 << qbits) & U32


def quantized(value: Column | str, qbits: int) -> Column:
    """The value without its low bits. Signed 32-bit numbers come out unsigned."""
    return (F.col(value) if isinstance(value, str) else value).bitwiseAND(F.lit(quantize_mask(qbits)))


def _number(tuning: BandTuning) -> str:
    """The type of band values and buckets; only a band of all 32 bits doesn't fit the smaller one."""
    return "int" if tuning.bits_per_band < 32 else "bigint"


def band_of(value: Column, band: int, tuning: BandTuning) -> Column:
    return F.shiftrightunsigned(value, band * tuning.bits_per_band).bitwiseAND(F.lit(tuning.buckets_per_band - 1)).cast(_number(tuning))


def extract_bands(value: Column | str, tuning: BandTuning) -> Column:
    """The bands of a value as an array, the lowest bits first."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array(*(band_of(value, k, tuning) for k in range(tuning.num_bands)))


def bucket_of(band: Column, band_value: Column, tuning: BandTuning) -> Column:
    return (band * F.lit(tuning.buckets_per_band) + band_value).cast(_number(tuning))


def overlap(left: Column, right: Column, offset: Column) -> Column:
    """How many positions two arrays share if ``left`` is entered at ``offset`` (``right`` at its negative)."""
    skip_left, skip_right = F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))
    return F.greatest(F.least(F.size(left) - skip_left, F.size(right) - skip_right), F.lit(0))


def bit_errors(left: Column, right: Column, offset: Column) -> Column:
    """Differing bits over the overlap of the two arrays at ``offset``."""
    n = overlap(left, right, offset)
    a = F.slice(left, F.greatest(offset, F.lit(0)) + 1, n)
    b = F.slice(right, F.greatest(-offset, F.lit(0)) + 1, n)
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint"))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)


def classify(ber: Column) -> Column:
    """The number of the match class of a bit error rate."""
    out = F
    for _, number, bound in CLASSES[:-1]:
        out = out.when(ber < F.lit(bound), F.lit(number))
    return out.otherwise(F.lit(CLASSES[-1][1]))


def class_name(score: Column) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name, _, _ in CLASSES)), score + 1)


def xor_deltas(values: Column | str) -> Column:
    """Each value but the first, xor the one before it; empty for arrays of one value or none."""
    v = F.col(values) if isinstance(values, str) else values
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n), lambda a, b: a.bitwiseXOR(b))


def varint_len(x: Column) -> Column:
    """Bytes of the variable-length encoding, 7 bits each."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).otherwise(5)


def varint_size(values: Column | str) -> Column:
    """Bytes of the xor-delta varint encoding; 0 for an empty array."""
    v = F.col(values) if isinstance(values, str) else values
    body = F.aggregate(F.transform(xor_deltas(v), varint_len), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.size(v) == 0, F.lit(0).cast("bigint")).otherwise(4 + body)


def bit_width(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def packed_size(values: Column | str, block: int = 128) -> Column:
    """Bytes of the block-packed encoding, whose width is that of the ninth tenth of a block's deltas, with larger
    ones as exceptions; 0 for an empty array."""
    v = F.col(values) if isinstance(values, str) else values
    starts = F.when(F.size(v) > 1, F.sequence(F.lit(1), F.size(v) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    # an array of one element binds what the inner functions use again and again
    blocks = F.transform(F.array(xor_deltas(v)), lambda d: F.transform(starts, lambda k: F.array_sort(F.transform(F.slice(d, k, block), bit_width))))[0]

    def size(widths: Column) -> Column:
        width = F.element_at(widths, F.greatest(F.floor(F.size(widths) * 9 / 10).cast("int"), F.lit(1)))
        over = F.size(F.filter(widths, lambda w: w > width))
        return (2 + F.ceil(F.size(widths) * width / 8) + 5 * over).cast("bigint")

    total = F.aggregate(F.transform(blocks, size), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.size(v) == 0, F.lit(0).cast("bigint")).otherwise(4 + total)
