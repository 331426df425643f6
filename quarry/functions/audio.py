"""Voice and music measures and grades. Waveforms are ``array<double>`` columns; decoding is a provider's task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.numeric import cascade, half_up


def mean_square(wave: Column) -> Column:
    total = F.aggregate(wave, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(wave) > 0, total / F.size(wave)).otherwise(F.lit(0.0))


def voice_level_db(wave: Column) -> Column:
    """Level over the mean square, floored at -120 dB."""
    return half_up(20 * F.log10(F.sqrt(F.greatest(F.lit(1e-12), mean_square(wave)))), 1)


def music_level_db(wave: Column) -> Column:
    """Level over the root mean square, floored at -240 dB."""
    return half_up(20 * F.log10(F.greatest(F.lit(1e-12), F.sqrt(mean_square(wave)))), 1)


def noise_ratio_db(wave: Column, rate: Column) -> Column:
    """Level of the whole over that of its first 20 ms (a quarter at most); null below ten samples of noise."""
    n = F.least((F.lit(0.02) * rate).cast("int"), (F.size(wave) / 4).cast("int"))
    floor = lambda w: F.greatest(F.lit(1e-12), F.sqrt(mean_square(w)))
    return F.when(n >= 10, half_up(20 * F.log10(floor(wave) / floor(F.slice(wave, F.lit(1), n))), 1))


def voice_issues(error: Column, duration: Column, rate: Column, level: Column, snr: Column, ext: Column) -> Column:
    """Ordered issue codes of a voice file; an unreadable one has just that."""
    found = F.array_compact(
        F.array(
            F.when(duration < 3, "too_short"), F.when(duration > 30, "too_long"), F.when(rate < 40000, "low_sample_rate"), F.when(level < -35, "too_quiet"),
            F.when(snr < 20, "noisy"), F.when(~F.lower(ext).isin("wav", "flac"), "lossy_format"),
        )
    )
    return F.when(error, F.array(F.lit("unreadable"))).otherwise(found)


def voice_grade(issues: Column, snr: Column) -> Column:
    n = F.size(issues)
    return cascade((F.array_contains(issues, "unreadable"), "F"), (F.array_contains(issues, "too_short"), "D"), (n > 1, "C"), (n == 1, "B"), (F.coalesce(snr, F.lit(0.0)) >= 30, "A"), otherwise="B")


def music_issues(error: Column, duration: Column, has_lyrics: Column, has_json: Column, has_caption: Column, has_meta: Column, bpm: Column, key: Column, level: Column) -> Column:
    """Ordered issue codes of a music file; zero tempo and an empty key count as missing."""
    found = F.array_compact(
        F.array(
            F.when(duration < 30, "too_short"), F.when(duration > 600, "too_long"), F.when(~has_lyrics, "missing_lyrics"), F.when(~has_json & ~has_caption, "missing_annotation"),
            F.when(has_meta & (F.coalesce(bpm, F.lit(0)) == 0), "no_bpm"), F.when(has_meta & (F.coalesce(key, F.lit("")) == ""), "no_key"), F.when(level < -30, "too_quiet"),
        )
    )
    return F.when(error, F.array(F.lit("unreadable"))).otherwise(found)


def music_grade(issues: Column) -> Column:
    n = F.size(issues)
    critical = F.exists(issues, lambda i: i.startswith("missing_"))
    return cascade((F.array_contains(issues, "unreadable"), "F"), (critical, "D"), (n > 1, "C"), (n == 1, "B"), otherwise="A")


def voice_overall(a: Column, b: Column, f: Column, total: Column) -> Column:
    return cascade((a / total > 0.7, "A"), ((a + b) / total > 0.6, "B"), (f == 0, "C"), otherwise="D")


def music_overall(ok: Column, f: Column, total: Column) -> Column:
    return cascade((f > 0, "D"), (ok / total > 0.8, "A"), (ok / total > 0.6, "B"), otherwise="C")
