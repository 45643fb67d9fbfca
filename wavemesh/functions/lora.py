"""LoRa timing, scoring and protocol limits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least SNR in dB that each spreading factor from 7 to 12 decodes.
SNR_FLOOR = (-7.5, -10.0, -12.5, -15.0, -17.5, -20.0)


def snr_floor(sf: Column) -> Column:
    """The threshold of a spreading factor; 999 outside 7 to 12."""
    return F.when(sf.between(7, 12), F.element_at(F.array(*map(F.lit, SNR_FLOOR)), F.least(F.greatest(sf - 6, F.lit(1)), F.lit(6)))).otherwise(999.0)


def _air(sf: Column, bw_khz: Column, cr: Column, size: Column) -> Column:
    symbol = F.pow(F.lit(2.0), sf) / bw_khz
    slow = F.when(symbol >= 16, 1).otherwise(0)
    top = 8 * size - 4 * sf + 28 + 16
    payload = 8 + F.when(top > 0, F.ceil(top / (4.0 * (sf - 2 * slow))) * cr).otherwise(0)
    return (F.when(sf <= 8, 32).otherwise(16) + 4.25) * symbol + payload * symbol


def airtime_ms(sf: Column, bw_khz: Column, cr: Column, size: Column) -> Column:
    """Whole milliseconds on air, explicit header and CRC; cr is the denominator, 5 to 8."""
    return F.floor(_air(sf, bw_khz, cr, size)).cast("long")


def airtime_exact_ms(sf: Column, bw_khz: Column, cr: Column, size: Column) -> Column:
    """Milliseconds on air, not truncated; cr held within 5 to 8, 0 for parameters that make no sense."""
    bad = ~((sf > 0) & (bw_khz > 0) & (size >= 0))
    return F.when(F.coalesce(bad, F.lit(True)), 0.0).otherwise(_air(sf, bw_khz, F.least(F.greatest(cr, F.lit(5)), F.lit(8)), size))


def on_air_bytes(payload: Column, hops: Column, hash_size: Column, scoped: Column) -> Column:
    return payload + 2 + hops * hash_size + F.when(scoped, 4).otherwise(0)


def packet_score(snr: Column, sf: Column, size: Column) -> Column:
    over = (snr - snr_floor(sf)) / 10
    return F.when((sf < 7) | (over < 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), over * (1 - size / 256.0))))


def rx_delay_ms(base: Column, score: Column, airtime: Column) -> Column:
    raw = ((F.pow(base, 0.85 - score) - 1) * airtime).cast("long")
    return F.when(base <= 0, 0).when(raw < 50, 0).when(raw > 32000, 32000).otherwise(raw).cast("long")


def retransmit_window_ms(airtime: Column, factor: Column) -> Column:
    """The longest delay that a relay may draw."""
    return 5 * (airtime * factor).cast("long")


def retransmit_delay_ms(airtime: Column, factor: Column, seed: str, *of: Column) -> Column:
    """A delay drawn from 0 up to the longest one, all equally likely. What it is drawn for, such as a packet and the
    relaying node, and the seed decide it, so a task that runs again draws the same."""
    bits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(c.cast("string") for c in of))), 1, 12)
    return F.pmod(F.conv(bits, 16, 10).cast("long"), retransmit_window_ms(airtime, factor) + 1)


def loop_limit(level: Column, hash_size: Column) -> Column:
    """How often a node's hash may stand in a path before it refuses; 0 never refuses."""
    return (
        F.when(level == "minimal", F.when(hash_size == 1, 4).when(hash_size == 2, 2).otherwise(1))
        .when(level == "moderate", F.when(hash_size == 1, 2).otherwise(1))
        .when(level == "strict", 1)
        .otherwise(0)
    )


def flood_limit(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0)) <= 0, 64).otherwise(value)


def message_hash_size(value: Column) -> Column:
    return F.when((F.coalesce(value, F.lit(0)) <= 0) | (value > 3), 3).otherwise(value)


def _times(h: Column, factor: int) -> Column:
    """The lower 32 bits of a product of 32-bit numbers, in two halves that stay within 64 bits."""
    high = F.pmod(F.shiftright(h, 16) * factor, F.lit(1 << 32))
    return F.pmod(F.pmod(high * 65536, F.lit(1 << 32)) + h.bitwiseAND(0xFFFF) * factor, F.lit(1 << 32))


def path_hash(node: Column, size: Column) -> Column:
    """A node's hash in paths: an avalanching 32-bit mix, cut to 1 to 3 bytes."""
    h = node.cast("long").bitwiseAND(0xFFFFFFFF)
    # The mix's two multipliers and three shifts.
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        h = h.bitwiseXOR(F.shiftright(h, shift))
        h = h if factor is None else _times(h, factor)
    bits = 8 * F.least(F.greatest(size, F.lit(1)), F.lit(3))
    return F.pmod(h, F.pow(F.lit(2), bits).cast("long"))


def interpolated(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """A line between two points, flat beyond them; y0 where they coincide."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - x0) / F.when(x1 != x0, x1 - x0)))
    return F.when(x1 == x0, y0).otherwise(y0 + t * (y1 - y0))


def snr_of_margin(margin: Column, sf: Column) -> Column:
    return snr_floor(F.least(F.greatest(sf, F.lit(7)), F.lit(12))) + margin


def snr_of_count(n: Column, sf: Column) -> Column:
    floor = snr_floor(F.least(F.greatest(sf, F.lit(7)), F.lit(12)))
    return F.when(n <= 0, floor - 10).otherwise(floor + F.least(F.lit(15.0), 3 * F.log2(1.0 + F.greatest(n, F.lit(0)))))


def capture(signal: Column, others: Column, floor_db: float = 6.0) -> Column:
    """Whether a signal survives the interferers' summed power, the floor included up to rounding. others: array of SNRs."""
    power = F.aggregate(others, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x / 10))
    return F.when(power <= 0, True).otherwise(signal - 10 * F.log10(F.when(power > 0, power)) >= floor_db - 1e-9)
