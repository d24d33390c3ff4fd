"""Scalar functions of the usage model as column expressions that stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_COUNT

# Provider words that bill per token, and hosts that run on the user's machine.
PAID_PROVIDERS = [
    "anthropic", "openai", "google", "gemini", "mistral", "cohere", "deepseek", "xai", "groq", "openrouter", "bedrock", "azure", "vertex", "fireworks", "deepinfra", "together", "togetherai", "perplexity", "copilot",
]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "ollama", "lmstudio", "llamacpp", "llama.cpp", "vllm", "local"]


def words(text: Column) -> Column:
    """The lower-case alphanumeric words of an identifier."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def has_word(text: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(words(text), F.array(*(F.lit(w) for w in vocabulary)))


def classify(provider: Column, model: Column, free_models: list[str] = (), rated_models: list[str] = ()) -> Column:
    """LOCAL, FREE, PAID, CLOUD or UNKNOWN; whole words decide, never parts of words. Null is read as ''."""
    p, m = F.lower(F.coalesce(provider, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    cloud = m.endswith(":cloud") | m.endswith("-cloud") | has_word(p, ["cloud"])
    plain = [h for h in LOCAL_HOSTS if h.isalnum()]
    local = has_word(p, plain) | has_word(m, plain)
    for host in LOCAL_HOSTS:
        local = local | p.contains(host)
    named_free = m.endswith("-free") | m.endswith(":free")
    free = m.isin(list(free_models)) | (~m.isin(list(rated_models)) & named_free)
    paid = has_word(p, PAID_PROVIDERS)
    return F.when(cloud, "CLOUD").when(local, "LOCAL").when(free, "FREE").when(paid, "PAID").otherwise("UNKNOWN")


def count_or_null(value: Column) -> Column:
    """A whole number from 0 to 2**53 of a JSON number given as double; anything else is null."""
    v = value.cast("double")
    return F.when((v == F.floor(v)) & (v >= 0) & (v <= float(MAX_COUNT)), F.floor(v).cast("long"))


def epoch_seconds(stamp: Column) -> Column:
    """Epoch seconds of a number in seconds, milliseconds (above 1e11) or microseconds (above 1e14)."""
    s = stamp.cast("long")
    return F.when(s > 10**14, F.floor(s / 1000000).cast("long")).when(s > 10**11, F.floor(s / 1000).cast("long")).otherwise(s)


def rfc3339_seconds(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 stamp, null if it is none."""
    t = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), text)
    return F.unix_timestamp(F.try_to_timestamp(F.upper(t)))


def project_path(path: Column) -> Column:
    """A path without trailing separators; one of separators only stays as it is, a blank one is null."""
    cut = F.regexp_replace(path, r"[/\\]+$", "")
    return F.when(F.trim(path) == "", F.lit(None)).when(cut == "", path).otherwise(cut)


def strip_date(model: Column) -> Column:
    """A model id without a trailing -YYYYMMDD or -YYYY-MM-DD."""
    return F.regexp_replace(model, r"-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$", "")


def dotted_version(model: Column) -> Column:
    """A model id whose runs of numbers joined by dashes are joined by dots."""
    return F.regexp_replace(model, r"(?<=^|-)([0-9]+)-(?=[0-9]+(?:-|$))", "$1.")


def model_candidates(model: Column) -> Column:
    """The ids under which a model may be listed, best first.

    First the id with its namespace, then its last segment; of each the forms as written, without a cloud suffix, and up to an @; of
    each form itself, dotted, undated, and both.
    """
    m = F.lower(F.trim(model))
    tail = F.when(m.contains("/"), F.regexp_extract(m, r"([^/]*)$", 1))
    out = []
    for seed in (m, tail):
        suffixes = [F.when(seed.endswith(x), F.substring(seed, F.lit(1), F.length(seed) - len(x))) for x in (":cloud", "-cloud")]
        for form in (seed, *suffixes, F.when(seed.contains("@"), F.substring_index(seed, "@", 1))):
            undated = F.when(strip_date(form) != form, strip_date(form))
            out += [form, dotted_version(form), undated, dotted_version(undated)]
    found = F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(m))


def scaled_round(value: Column, digits: int) -> Column:
    """Binary rounding half away from zero: the scaled value is rounded, not its decimal text."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent; null over zero."""
    return scaled_round(F.try_divide(part * 100.0, whole), digits)


def format_count(n: Column) -> Column:
    """1234567 as 1.2M."""
    v = n.cast("double")
    one = lambda x: F.format_string("%.1f", x)
    return F.when(v >= 1e9, F.concat(one(v / 1e9), F.lit("B"))).when(v >= 1e6, F.concat(one(v / 1e6), F.lit("M"))).when(v >= 1e3, F.concat(one(v / 1e3), F.lit("K"))).otherwise(n.cast("long").cast("string"))


def format_duration(seconds: Column) -> Column:
    """<1m, 14m, 2h 14m or 1d 3h."""
    s = seconds.cast("long")
    m, h, d = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long"), F.floor(s / 86400).cast("long")
    return (
        F.when(s < 60, "<1m").when(h < 1, F.concat(m.cast("string"), F.lit("m")))
        .when(d < 1, F.concat(h.cast("string"), F.lit("h "), F.format_string("%02d", m % 60), F.lit("m"))).otherwise(F.concat(d.cast("string"), F.lit("d "), (h % 24).cast("string"), F.lit("h")))
    )


def share_label(part: Column, whole: Column) -> Column:
    """A whole percentage; <1% for a share below it, null for no share at all."""
    pct = F.try_divide(part * 100.0, whole)
    return F.when(pct.isNull() | (pct == 0), F.lit(None).cast("string")).when(pct < 1, "<1%").otherwise(F.concat(F.round(pct).cast("long").cast("string"), F.lit("%")))


def window_label(minutes: Column, secondary: Column | None = None) -> Column:
    """The name of a rate-limit window by its length; one without length goes by its place."""
    per = lambda n: F.floor(minutes / n).cast("long").cast("string")
    named = F.when(minutes == 300, "Session (5-hour)").when(minutes == 10080, "Weekly (7-day)").when(minutes % 1440 == 0, F.concat(per(1440), F.lit("-day window"))).when(minutes % 60 == 0, F.concat(per(60), F.lit("-hour window")))
    named = named.otherwise(F.concat(minutes.cast("string"), F.lit("-minute window")))
    place = F.when(F.coalesce(secondary, F.lit(False)) if secondary is not None else F.lit(False), "Secondary window").otherwise("Primary window")
    return F.when(minutes > 0, named).otherwise(place)


def plan_label(tier: Column) -> Column:
    """A plan's name from a tier id: what follows `max_` as a multiple, else a word of it; null for any other."""
    t = F.lower(tier)
    times = F.regexp_extract(t, "max_([0-9x]*)", 1)
    named = F.when(t.contains("max_"), F.when(times.endswith("x") & (F.length(times) > 1), F.concat(F.lit("Max "), times)).otherwise("Max"))
    for word in ("enterprise", "team", "pro"):
        named = named.when(has_word(t, [word]), word.capitalize())
    return named


def session_of_file(name: Column) -> Column:
    """The session id at the end of a rollout file's name: its last five dash-joined parts, up to an underscore, of 36 characters."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.jsonl(?:\.zst)?$", "")
    found = F.regexp_extract(F.regexp_extract(stem, r"(?:^|-)([^-]*(?:-[^-]*){4})$", 1), r"^[^_]*", 0)
    return F.when(F.length(found) == 36, found)


def url_host(url: Column) -> Column:
    """The host that a URL names, without scheme, user, port, path and the brackets of an IPv6 address."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(url)
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", "")
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(host, r"^[^:]*", 0))


def strip_html(html: Column) -> Column:
    """The text of a piece of HTML: tags out, common entities read, white space joined."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    # Entities.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes; dots stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9.]+", "-"), r"^-+|-+$", "")


def listed_price(text: Column) -> Column:
    """The amount of a listed price such as $1.25; 0 for `free`, null for anything else."""
    t = F.trim(text)
    return F.when(F.lower(t) == "free", F.lit(0.0)).otherwise(F.regexp_extract(t, r"^\$([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double"))


def csv_guard(field: Column) -> Column:
    """A CSV field that a spreadsheet won't run: a leading = + - @ tab or return gets a quote unless it is a number."""
    return F.when(field.rlike(r"^[=+\-@\t\r]") & field.try_cast("double").isNull(), F.concat(F.lit("'"), field)).otherwise(field)


def four_digits(value: Column) -> Column:
    """A number from 0 with four decimals, rounded by its exact binary value, ties to even (format_string rounds its shortest decimal)."""
    product = value * 10000.0
    high = value * 134217729.0 - (value * 134217729.0 - value)  # the upper half of the digits: both halves times 10000 are exact
    error = (high * 10000.0 - product) + (value - high) * 10000.0
    whole = F.floor(product)
    beyond = (product - whole) - 0.5
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = (whole + up.cast("int")).cast("long")
    return F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def cost_display(status: Column, cost: Column) -> Column:
    """How a row's cost is shown; an unknown one is never a figure, and a status without its figure says so."""
    figure = F.when(cost.isNotNull(), F.concat(F.lit("$"), four_digits(cost), F.lit(" "), status)).otherwise(F.concat(F.upper(status), F.lit(" / NO COST")))
    return F.when(status == "local", "LOCAL").when(status == "free", "FREE").when(status == "quota", "ON QUOTA").when(status == "unavailable", "UNKNOWN COST").otherwise(figure)


def cost_sort_key(status: Column, cost: Column) -> Column:
    """Free and local sort as 0; quota and unavailable have no place on the scale."""
    return F.when(status.isin("free", "local"), F.lit(0.0)).when(status.isin("quota", "unavailable"), F.lit(None).cast("double")).otherwise(cost)


def coverage_label(pct: Column, quota_requests: Column) -> Column:
    """What a total stands on: all priced from 99.95 %, else the share, beside the requests on quota."""
    quota = F.concat(format_count(quota_requests), F.lit(" on quota"))
    priced = F.when(pct >= 99.95, "all priced").when(pct.isNotNull(), F.concat(F.format_string("%.0f", pct), F.lit("% priced")))
    return F.when(quota_requests > 0, F.concat_ws(" · ", priced, quota)).otherwise(F.coalesce(priced, F.lit("")))
