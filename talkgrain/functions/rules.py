"""Rules as columns: what a value becomes, or whether a row may pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that a client may report, severities and outcomes.
CLIENT_CODES = tuple(f"transport.{what}" for what in ("connection_failed", "connection_lost", "reconnect_failed", "audio_playback_failed", "microphone_failed"))
SEVERITIES = ("info", "warning", "error", "critical")
#: Wordings that state a lasting fact of the speaker.
FACT = r"\b(my name is|call me|i am from|i live in|i work as|i work at|i like|i love|i prefer|i dislike|i hate|my goal is|i want to|my preferred language is|i speak)\b"


def states_a_fact(text: Column) -> Column:
    """A statement, no question, that tells something lasting of the speaker."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return (t != "") & ~t.endswith("?") & t.rlike(FACT)


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def client_event(code: Column, details: Column, chars: int) -> Column:
    """accepted, unknown_code or too_large."""
    return F.when(~F.coalesce(code.isin(*CLIENT_CODES), F.lit(False)), "unknown_code").when(F.length(F.coalesce(details, F.lit(""))) > chars, "too_large").otherwise("accepted")


def direct_answer(metadata: Column, voice_answer: Column, live: Column) -> Column:
    """Whether a hit may be spoken as it stands: approved, atomic, reviewed, with a voice answer, not live. metadata: a map of flags."""
    flag = lambda k: F.coalesce(F.element_at(metadata, k), F.lit(False))
    return flag("voice_answer_approved") & flag("atomic_answer") & flag("answerability_reviewed") & (F.coalesce(voice_answer, F.lit("")) != "") & ~F.coalesce(live, F.lit(False))


def safe_source(kind: Column, uri: Column) -> Column:
    """Whether an address suits its kind of source: web sources by http(s), others by a logical address of their own scheme."""
    u = F.lower(F.trim(uri))
    logical = kind.isin("internal", "taxonomy", "api") & u.rlike(r"^[a-z]+://[a-z0-9][a-z0-9._/-]+$") & (F.substring_index(u, "://", 1) == kind)
    return F.coalesce(F.when(kind.isin("website", "pdf", "manual"), u.rlike(r"^https?://[^/\s]+")).otherwise(logical), F.lit(False))


def measured(value: Column) -> Column:
    """A number of at least 0, else null."""
    return F.when((value >= 0) & ~F.isnan(value), value)


def live_latency(stt: Column, preparation: Column, llm: Column, tts: Column, provider: Column, audio: Column, sent: Column, stopped: Column) -> Column:
    """struct(perceived, server, gap): server is the answer's audio or else the sum of three parts; gap what the client saw beyond it."""
    total = measured(stt) + measured(F.coalesce(preparation, llm)) + measured(F.coalesce(tts, provider))
    server, perceived = F.coalesce(measured(audio), total), F.coalesce(measured(sent), measured(stopped))
    return F.struct(perceived.alias("perceived"), server.alias("server"), F.when(perceived >= server, F.round(perceived - server, 1)).alias("gap"))


def guarded(text: Column, markers: list[str]) -> Column:
    """struct(shown, rejected_chars, rejected_hash): what comes before the first marker, whatever its case; length and digest of the rest."""
    low = F.lower(text)
    places = F.array(*[F.nullif(F.locate(m.lower(), low), F.lit(0)) for m in markers])
    at = F.array_min(F.array_compact(places))
    rest = F.substring(text, at, F.length(text))
    return F.struct(F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1)).alias("shown"), F.coalesce(F.length(rest), F.lit(0)).alias("rejected_chars"), F.sha2(rest, 256).alias("rejected_hash"))


def shown_status(status: Column, own: Column) -> Column:
    """A tool's own status before the call's, with spaces for underscores; empty without any."""
    return F.replace(F.coalesce(F.nullif(own, F.lit("")), status, F.lit("")), F.lit("_"), F.lit(" "))


def plain_chars(markdown: Column) -> Column:
    """struct(links, chars): links of a text, and its length when links are but their label."""
    link = r"\[([^\[\]]*)\]\([^()]*\)"
    return F.struct(F.regexp_count(markdown, F.lit(link)).alias("links"), F.length(F.regexp_replace(markdown, link, "$1")).alias("chars"))


def case_problems(tool: Column, expected: Column, said: Column, terms: Column, clarify: Column) -> Column:
    """What is wrong with an answer: another tool than expected, terms missing, no clarification. Empty for a pass."""
    low = F.lower(F.coalesce(said, F.lit("")))
    missing = F.filter(terms, lambda t: ~F.contains(low, t))
    unclear = (F.size(clarify) > 0) & ~F.exists(clarify, lambda t: F.contains(low, t))
    return F.array_compact(F.array(F.when(~tool.eqNullSafe(expected), "tool"), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))), F.when(unclear, "clarification")))


def summary_message(role: Column, content: Column, marker: str, scoped: str) -> Column:
    """What of a message goes into a summary; null for none: other roles, empty texts, texts scoped to one query, markup of an assistant."""
    from talkgrain.operators.memory import free_of_markup

    t = F.trim(F.coalesce(content, F.lit("")))
    t = F.when((role == "user") & t.startswith(marker), F.trim(F.substring(t, F.lit(len(marker) + 1), F.length(t)))).otherwise(t)
    ok = role.isin("user", "assistant") & (t != "") & ~F.contains(t, F.lit(scoped)) & ((role == "user") | free_of_markup(t))
    return F.when(ok, t)


def epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def pcm_ms(n_bytes: Column, rate: int, channels: int = 1, width: int = 2) -> Column:
    """Milliseconds of raw audio of so many bytes."""
    return F.round(n_bytes * 1000 / (rate * channels * width), 1)
