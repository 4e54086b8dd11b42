"""Removal of credentials and absolute paths from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
SENSITIVE_KEYS = ["access_key", "api_key", "apikey", "auth", "authorization", "conn_str", "connection_string",
                  "connectionstring", "cookie", "credential", "credentials", "passphrase", "passwd", "password",
                  "private_key", "pwd", "secret", "session_key", "token"]
SCHEME_MARKERS = ["bearer", "basic"]
REDACTED = "[redacted]"
REDACTED_PATH = "[path]"
# -------------------------------------------------------------------------------


_SPACE = r"\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_KEYS = "(?i:" + "|".join(SENSITIVE_KEYS) + ")"
_PUNCTUATION = rf"[^{_SPACE}A-Za-z0-9_\-=]*+"
_PUNCTUATION_OR_EQUALS = rf"[^{_SPACE}A-Za-z0-9_\-]*"
# A bare credential word. One that is followed by "=" is an assignment instead, unless a "=" precedes it.
_MARKER = (
    rf"(?<![^{_SPACE}])(?:{_PUNCTUATION}{_KEYS}{_PUNCTUATION}"
    rf"|{_PUNCTUATION}={_PUNCTUATION_OR_EQUALS}{_KEYS}{_PUNCTUATION_OR_EQUALS}"
    rf"|(?i:{'|'.join(SCHEME_MARKERS)}):*+)(?![^{_SPACE}])"
)
_ASSIGNED = rf"^({_PUNCTUATION}{_KEYS}{_PUNCTUATION})="
_USERINFO = r"(?s)^(.*?://)[^/@]*(@.*)$"
_SUSPECT = r"[=/\\]|^eyJ"


def is_absolute_path(token: Column) -> Column:
    return token.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|//|/[^/]+/)")


def _scrub_token(token: Column) -> Column:
    jwt = token.startswith("eyJ") & token.rlike(r"\..*\.") & (F.octet_length(token) > 20)
    return (
        F.when(~token.rlike(_SUSPECT), token)
        .when(token.rlike(_ASSIGNED), F.concat(F.regexp_extract(token, _ASSIGNED, 1), F.lit("=" + REDACTED)))
        .when(jwt, REDACTED)
        .when(token.rlike(_USERINFO), F.regexp_replace(token, _USERINFO, "$1" + REDACTED + "$2"))
        .when(is_absolute_path(token), REDACTED_PATH)
        .otherwise(token)
    )


def scrub(text: Column) -> Column:
    """The text with credentials and absolute paths replaced, whitespace kept.

    A bare marker such as ``password:`` drops everything after it, to the end of the text.
    Only texts, and in them only words, with a suspicious character are looked at closely.
    """
    at = F.regexp_instr(text, F.lit(_MARKER))
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    runs = F.regexp_extract_all(head, F.lit(rf"([{_SPACE}]++|[^{_SPACE}]++)"), F.lit(1))
    body = F.when(head.rlike(r"[=/\\]|eyJ"), F.array_join(F.transform(runs, _scrub_token), "")).otherwise(head)
    tail = F.when(at > 0, F.concat(F.regexp_extract(text, _MARKER, 0), F.lit(" " + REDACTED))).otherwise(F.lit(""))
    return F.when(F.contains(text, F.lit("PRIVATE KEY")), REDACTED).otherwise(F.concat(body, tail))
