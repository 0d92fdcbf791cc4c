"""Speech requests and player states: validation, routing, outcomes, frames and labels as column expressions."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from plectrum.functions.text import blank, units

# Voices by language and engine, the first is the default.
VOICES = {
    ("es", "default"): ("ef_dora", "em_alex", "em_santa"),
    ("en", "default"): ("af_heart", "af_bella", "bf_emma"),
    ("es", "edge"): ("es-ES-XimenaNeural", "es-ES-AlvaroNeural", "es-ES-ElviraNeural", "es-MX-JorgeNeural", "es-AR-EloisaNeural"),
    ("en", "edge"): ("en-US-AriaNeural", "en-US-GuyNeural", "en-GB-RyanNeural"),
}
#: Names of neural voices that may stand in markup.
NEURAL_VOICE = r"^[a-z]{2}-[A-Z]{2}-[A-Za-z0-9]+Neural\z"
MAX_REQUEST_CHARS = 10_000


def is_neural_voice(voice: Column) -> Column:
    return F.coalesce(voice.rlike(NEURAL_VOICE), F.lit(False))


def resolve_engine(choice: Column, lang: Column, available: Column) -> Column:
    """An available choice wins; else Spanish takes ``edge`` where there is one; else ``default``."""
    chosen = (choice != "auto") & F.array_contains(available, choice)
    return F.when(chosen, choice).when((lang == "es") & F.array_contains(available, F.lit("edge")), "edge").otherwise("default")


def voice_for(lang: Column, engine: Column, wanted: Column) -> Column:
    """The wanted voice if the engine has it for the language, else the first it has."""
    lists = F.create_map(*[x for (la, e), names in VOICES.items() for x in (F.lit(f"{la}/{e}"), F.array(*map(F.lit, names)))])
    own = F.element_at(lists, F.concat(F.when(lang == "es", "es").otherwise("en"), F.lit("/"), F.when(engine == "edge", "edge").otherwise("default")))
    return F.when(F.array_contains(own, wanted), wanted).otherwise(F.element_at(own, 1))


def safe_voice(engine: Column, wanted: Column, default: Column) -> Column:
    """The voice a server uses: names out of pattern fall back where they would stand in markup."""
    return F.when((engine == "edge") & wanted.isNotNull() & ~is_neural_voice(wanted), default).otherwise(F.coalesce(wanted, default))


def request_problem(text: Column, speed: Column, fmt: Column, most: int = 600) -> Column:
    """Why a request is refused, or null: text of 1 to 10000 units, at most ``most``; speed of .5 to 2; a known format."""
    n = F.coalesce(units(text), F.lit(0))
    bad = (n < 1) | (n > MAX_REQUEST_CHARS) | (speed.isNotNull() & ~speed.between(0.5, 2)) | (fmt.isNotNull() & ~fmt.isin("mp3", "wav", "opus"))
    return F.when(bad, "invalid_request").when(n > most, "too_large")


def provider_issues(enabled: Column, settings: Mapping[str, Column]) -> Column:
    """What an enabled provider lacks, in the order of its settings; none if it is off."""
    told = [F.when(F.coalesce(v, F.lit("")) == "", F.lit(f"{k} is required when provider is enabled")) for k, v in settings.items()]
    return F.when(enabled, F.array_compact(F.array(*told))).otherwise(F.array().cast("array<string>"))


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def ticks_to_seconds(ticks: Column) -> Column:
    return ticks / 10_000_000


def phase_by_elapsed(ms: Column) -> Column:
    """Where a request that ran into its deadline probably stood."""
    return F.when(ms <= 5_000, "queue").when(ms <= 20_000, "connect").when(ms <= 40_000, "first_byte").otherwise("stream")


def deadline(ms: Column, total: int = 60_000) -> Column:
    """The phase of a request that took longer than the total deadline, else null."""
    return F.when(ms >= total, phase_by_elapsed(ms))


def reader_phase(raw: Column, player: Column, preparing: Column, first_ready: Column, queued: Column, exporting: Column, error: Column) -> Column:
    """The one state that a reader shows; the order of the cases decides."""
    busy = raw.isin("extracting", "loading")
    failed = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(exporting, "exporting")
        .when(failed & ~busy, "error")
        .when((raw == "empty") | busy, raw)
        .when(player == "ended", "ready")
        .when(player.isin("playing", "paused", "error"), player)
        .when((raw == "ready") & preparing, "preparing")
        .when((raw == "ready") & first_ready & ~queued, "ready")
        .when(raw == "ready", "preparing")
        .otherwise("ready")
    )


def can_resume(position: Column) -> Column:
    """Whether a stored document time can be resumed."""
    return F.coalesce(position > 0, F.lit(False))


def outcome(problem: Column, limited: Column, hit: Column, cancelled: Column, error: Column, took_ms: Column) -> Column:
    """The logged outcome of a request: the first that applies on its way through the handler."""
    return (
        F.when(problem.isNotNull(), "refused")
        .when(limited, "queue_rejected")
        .when(hit, "cache_hit")
        .when(cancelled, "cancelled")
        .when((error == "provider_timeout") | (took_ms >= 60_000), "timeout")
        .when(error.isNotNull(), "provider_error")
        .otherwise("generated")
    )


def status_code(problem: Column, outcome: Column, error: Column) -> Column:
    return (
        F.when(problem == "too_large", 413)
        .when((problem == "invalid_request") | (error == "invalid_request"), 400)
        .when((outcome == "queue_rejected") | (error == "rate_limited"), 429)
        .when(outcome == "cancelled", 499)
        .when(outcome == "timeout", 504)
        .when(outcome == "provider_error", 502)
        .otherwise(200)
    )


def little_endian_32(n: Column) -> Column:
    """Four bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[h.substr(F.lit(a), F.lit(2)) for a in (7, 5, 3, 1)]))


def frame(metadata: Column, without_boundaries: Column, audio: Column, most: int = 64 * 1024) -> Column:
    """Length, JSON and audio in one binary; JSON above ``most`` bytes goes without its boundaries."""
    told = F.encode(F.when(F.octet_length(metadata) > most, without_boundaries).otherwise(metadata), "UTF-8")
    return F.concat(little_endian_32(F.octet_length(told)), told, audio)


def parse_frame(data: Column, most: int = 64 * 1024) -> Column:
    """struct<problem, metadata, audio> of a frame."""
    n = F.conv(F.concat(*[F.hex(F.substring(data, a, 1)) for a in (4, 3, 2, 1)]), 16, 10).cast("long")
    size = F.octet_length(data)
    problem = F.when(size < 4, "malformed_frame").when((n < 2) | (n > most), "malformed_frame_metadata").when(size < 4 + n, "truncated_frame")
    part = F.substring(data, F.lit(5), n.cast("int"))
    problem = F.coalesce(problem, F.when(~F.is_valid_utf8(part.cast("string")), "malformed_frame_metadata"))
    return F.struct(
        problem.alias("problem"),
        F.when(problem.isNull(), part.cast("string")).alias("metadata"),
        F.when(problem.isNull(), F.substring(data, (n + 5).cast("int"), size)).alias("audio"),
    )


def header_json(value: Column) -> Column:
    """A nested value as a header can carry it: compact JSON in base 64."""
    return F.base64(F.encode(F.to_json(value), "UTF-8"))


def log_line(at: Column, level: Column, message: Column, *fields_: Column) -> Column:
    """One structured log line; null fields are left out."""
    return F.to_json(F.struct(at.alias("ts"), level.alias("level"), message.alias("msg"), *fields_))


def csv_field(value: Column) -> Column:
    """A field quoted only where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n]'), quoted).otherwise(value)


def csv_line(*values: Column) -> Column:
    return F.array_join(F.array(*[csv_field(F.coalesce(v.cast("string"), F.lit(""))) for v in values]), ",")


def marks_table(text: Column, type_: Column) -> Column:
    """Whether a segment reads a table: by its block, or by its words where the format has no cells."""
    return (type_ == "table-cell") | text.rlike(r"(?:^|\s)(?:Fila|Row)\s")


def marks_footnote(text: Column, type_: Column) -> Column:
    return (type_ == "footnote") | text.rlike(r" Nota [0-9]+:")


def heard(muted: Column, text: Column) -> Column:
    return ~muted & ~blank(text)


# --- settings ---------------------------------------------------------------------------------------


def _flag(value: str) -> bool:
    return value in ("1", "true")


@dataclass(frozen=True)
class Settings:
    """Typed settings with defaults and bounds, read from names in capitals."""

    speech_provider: str = "mock"
    speech_timeout_ms: int = 30_000
    speech_max_concurrency: int = 1
    speech_requests_per_minute: int = 20
    speech_max_attempts: int = 3
    speech_max_text_chars: int = 600
    speech_default_speed: float = 1.0
    api_rate_limit_per_minute: int = 60
    api_max_body_bytes: int = 16_384
    edge_tts_enabled: bool = False
    log_level: str = "info"
    cloud_base_url: str | None = None
    cloud_api_key: str | None = None


# Bounds and choices.
_BOUNDS = {
    "speech_timeout_ms": (1000, 120_000), "speech_max_concurrency": (1, 4), "speech_requests_per_minute": (1, 100_000), "speech_max_attempts": (1, 6),
    "speech_max_text_chars": (50, 4000), "speech_default_speed": (0.5, 2), "api_rate_limit_per_minute": (1, 1000), "api_max_body_bytes": (1024, float("inf")),
}
_CHOICES = {"speech_provider": ("mock", "cloud"), "log_level": ("debug", "info", "warn", "error")}


def load_settings(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from the environment; all problems are told at once."""
    env, found, issues = os.environ if env is None else env, {}, []
    for f in fields(Settings):
        raw = env.get(f.name.upper())
        if raw is None or (raw == "" and f.default is None):
            continue
        try:
            value = _flag(raw) if isinstance(f.default, bool) else type(f.default)(raw) if f.default is not None else raw
        except ValueError:
            issues.append(f"{f.name.upper()}: not a number")
            continue
        low, high = _BOUNDS.get(f.name, (None, None))
        if low is not None and not low <= value <= high:
            issues.append(f"{f.name.upper()}: out of {low} to {high}")
        if f.name in _CHOICES and value not in _CHOICES[f.name]:
            issues.append(f"{f.name.upper()}: not one of {', '.join(_CHOICES[f.name])}")
        found[f.name] = value
    if found.get("cloud_api_key") is not None and len(found["cloud_api_key"]) < 8:
        issues.append("CLOUD_API_KEY: too short")
    if found.get("speech_provider") == "cloud" and not (found.get("cloud_base_url") and found.get("cloud_api_key")):
        issues.append("CLOUD_BASE_URL and CLOUD_API_KEY are required")
    if issues:
        raise ValueError("; ".join(issues))
    return Settings(**found)
