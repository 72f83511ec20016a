"""Secret redaction over text columns."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[redacted]"

# What counts as a secret and what replaces it, most specific rule first.
# Java regex; a replacement may keep a captured scheme or key name, never the secret.
# The third value is a lower-case text without which the rule cannot match.
RULES: tuple[tuple[str, str, str], ...] = (
    (r'(?i)\bAuthorization\s*:\s*(Bearer|Basic|Token|Digest)\s+(?!\[)[^\s,"\r\n]+', "Authorization: $1 [redacted]", "authorization"),
    (r"(?i)\bBearer\s+(?!\[)[A-Za-z0-9._\-+/=]{8,}", "Bearer [redacted]", "bearer"),
    (r'(?i)\bAuthorization\s*:\s*(?!Bearer\b|Basic\b|Token\b|Digest\b|\[)[^\s",]+', "Authorization: [redacted]", "authorization"),
    (r"\bsk-ant-[A-Za-z0-9_\-]{8,}", "[redacted]", "sk-ant-"),
    (r"\bsk-[A-Za-z0-9_\-]{16,}", "[redacted]", "sk-"),
    (r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[redacted]", "eyj"),
    (r"(?i)postgres(?:ql)?://[^\s'\"<>]*", "postgres://[redacted]", "postgres"),
    (r":[^@\s'\"]+@", ":[redacted]@", "@"),
    (r"(?i)password\s*=\s*[^\s&'\"]+", "password=[redacted]", "password"),
    (r'"(refresh_token|access_token|refreshToken|accessToken)"\s*:\s*"[^"]*"', '"$1": "[redacted]"', "token"),
)

# Attribute keys that never leave the pipeline (fixed values).
DENIED_ATTRIBUTES = (
    "http.request.header.authorization",
    "http.response.header.set-cookie",
    "db.user",
    "p4d.password",
    "openrouter.api_key",
    "postgres.password",
)


def redact(text: Column | str, extra_rules: Sequence[tuple[str, ...]] = (), literals: Sequence[str] = ()) -> Column:
    """Replace secrets in a text column; a second pass changes nothing.  NULL becomes the empty text.

    Most texts hold no secret, so the patterns run only where the text contains what one of the rules
    needs.  Extra rules are (pattern, replacement) or (pattern, replacement, needed text); one without a needed
    text opens every text.  ``literals`` are secret values to remove verbatim; those under 8 characters are ignored.
    """
    source = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    rules = (*RULES, *extra_rules)
    clean = source
    for pattern, replacement, *_ in rules:
        clean = F.regexp_replace(clean, F.lit(pattern), F.lit(replacement))
    needed = sorted({rule[2] for rule in rules if len(rule) > 2})
    out = clean
    if all(len(rule) > 2 for rule in rules):
        lowered = F.lower(source)
        out = F.when(functools.reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(x)) for x in needed]), clean).otherwise(source)
    for literal in literals:
        if len(literal.strip()) >= 8:
            out = F.replace(out, F.lit(literal.strip()), F.lit(REDACTED))
    return out


def redact_tail(text: Column | str, keep: int, **options) -> Column:
    """Redact, then keep the last ``keep`` characters."""
    return F.right(redact(text, **options), F.lit(keep))


# Command-line flags whose value is a secret, and flags whose value is free text (fixed values).
SECRET_FLAGS = ("--api-key", "--token", "--auth-token", "--bearer", "--password", "--secret")
TEXT_FLAGS = ("-p", "--prompt", "--system", "--system-prompt")


def redact_arguments(arguments: Column | str, text_limit: int = 240) -> Column:
    """An array of command-line arguments for display.

    The value after a secret flag is replaced, the value after a free-text flag is redacted and
    shortened, everything else is redacted.  A value is never taken for a flag.
    """
    def step(state: Column, argument: Column) -> Column:
        clean = redact(argument)
        short = F.when(F.length(clean) > text_limit, F.concat(F.left(clean, F.lit(text_limit)), F.lit("…[truncated]"))).otherwise(clean)
        shown = F.when(state["after"] == "secret", REDACTED).when(state["after"] == "text", short).otherwise(clean)
        after = (F.when(state["after"] != "", "").when(argument.isin(*SECRET_FLAGS), "secret")
                 .when(argument.isin(*TEXT_FLAGS), "text").otherwise(""))
        return F.struct(F.concat(state["shown"], F.array(shown)).alias("shown"), after.alias("after"))

    start = F.struct(F.array().cast("array<string>").alias("shown"), F.lit("").alias("after"))
    return F.aggregate(arguments, start, step, lambda state: state["shown"])


def drop_denied(attributes: Column | str, denied: Sequence[str] = DENIED_ATTRIBUTES) -> Column:
    """Remove denied keys from a map column."""
    return F.map_filter(attributes, lambda key, _: ~key.isin(*denied))


def fingerprint(text: Column | str, token_pattern: str = r"\bps_[a-z_]+") -> Column:
    """Sorted distinct tokens of a text that match a pattern (by default mirror table names)."""
    tokens = F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text),
                                  F.lit(token_pattern), F.lit(0))
    return F.sort_array(F.array_distinct(tokens))

