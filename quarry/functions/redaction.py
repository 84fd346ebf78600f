"""Redaction of credentials in texts, as an ordered chain of replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token shapes and what stands in for them, in order.
TOKEN_SHAPES = (
    (r"(?i)\bBearer\s+(?!\[REDACTED:)\S{16,}", "Bearer [REDACTED:token]"),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED:aws-access-key]"),
    (r"\bgh[oprsu]_[A-Za-z0-9]{20,}\b", "[REDACTED:token]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED:token]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED:token]"),
    (r"(?i)(https?://)(?!\[REDACTED:)[^\s@]+@", "$1[REDACTED:credentials]@"),
)
#: vendors' token shapes, in order.
VENDOR_SHAPES = (
    (r"\bLS0tLS1CRUdJT[A-Za-z0-9+/=]{40,}", "[REDACTED:private-key]"),
    (r"\b(?:sk|rk)_(?:test|live|prod)_[A-Za-z0-9]{10,99}\b", "[REDACTED:token]"),
    (r"\bAIza[\w-]{35}(?![\w-])", "[REDACTED:token]"),
    (r"\bSG\.[A-Za-z0-9=_\-.]{66}", "[REDACTED:token]"),
    (r"\bpplx-[A-Za-z0-9]{48}\b", "[REDACTED:token]"),
    (r"\bpat[A-Za-z0-9]{14}\.[a-f0-9]{64}\b", "[REDACTED:token]"),
    (r"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}", "[REDACTED:secret]"),
    (r"\bey[A-Za-z0-9]{17,}\.ey[A-Za-z0-9/\\_-]{17,}\.[A-Za-z0-9/\\_-]{10,}={0,2}", "[REDACTED:token]"),
    (r"\bsgp_(?:[a-fA-F0-9]{16}_|local_)?[a-fA-F0-9]{40}\b", "[REDACTED:token]"),
    (r"\bsl\.[A-Za-z0-9\-=_]{135}", "[REDACTED:token]"),
    (r"\bgithub_pat_\w{82}\b", "[REDACTED:token]"),
    (r"\bglpat-[\w-]{20}\b", "[REDACTED:token]"),
    (r"\bnpm_[A-Za-z0-9]{36}\b", "[REDACTED:token]"),
    (r"\bhf_[A-Za-z]{34}\b", "[REDACTED:token]"),
    (r"\bdo[opr]_v1_[a-f0-9]{64}\b", "[REDACTED:token]"),
    (r"\bshp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}\b", "[REDACTED:token]"),
    (r"\blin_api_[A-Za-z0-9]{40}\b", "[REDACTED:token]"),
    (r"\bpypi-AgEIcHlwaS5vcmc[\w-]{50,}", "[REDACTED:token]"),
    (r"\bPMAK-[a-f0-9]{24}-[a-f0-9]{34}\b", "[REDACTED:token]"),
    (r"\b[0-9]{5,16}:AA[A-Za-z0-9_-]{33}\b", "[REDACTED:token]"),
)
#: A key block with its markers, and one that is cut off before its end.
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
CUT_OFF_KEY = r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----)\s*(?:[A-Za-z0-9+/=]{16,}\s*)+"
#: Names whose values are secrets, and values that are none: code, paths, names, placeholders.
SECRET_NAMES = r"(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|auth[_-]?token|token|passw(?:or)?d|passwd|pwd)"
ASSIGNED = rf"(?i)\b([A-Z0-9_-]*{SECRET_NAMES})(\s*[:=]\s*)([\x22'`]?)(?!\[REDACTED)(?![A-Za-z_.]+\(|[~./][\w./-]*/|\$\{{?[A-Z_]+\}}?|(?:null|none|true|false|undefined)\b)([^\s\x22'`,;]{{8,}})\3"
#: A value that is worth hiding: not redacted yet, and no code, path, variable or placeholder.
_VETO = r"(?!\[REDACTED)(?![A-Za-z_.]+\(|[~./][\w./-]*/|\$\{?[A-Z_]+\}?|(?:null|none|true|false|undefined)\b)"
#: A row of a Markdown table that names a secret beside its value, and a value told in a sentence.
TABLE_ROW = rf"(?im)^([ \t]*\|[ \t]*[`*]*[\w -]*{SECRET_NAMES}[\w -]*[`*]*:?[ \t]*\|[ \t]*)([`]?){_VETO}([^\s|`]{{8,}})\2(?=[ \t]*\|)"
TOLD = rf"(?i)\b({SECRET_NAMES})(\s+(?:is|es|was|era)\s*:?\s+)([\x22'`]){_VETO}([^\s\x22'`]{{8,}})\3"
#: What at least one shape above needs.
ANY_SHAPE = (
    r"(?i)PRIVATE KEY|Bearer\s|://|key[\x22\x27`*]*\s*[:=|]|secret[\x22\x27`*]*\s*[:=|]|token[\x22\x27`*]*\s*[:=|]|(?:key|secret|token)\s+(?:is|es|was|era)\b|passw|pwd|AKIA|ASIA[A-Z0-9]{16}|gh[oprsu]_|sk-|xox[baprs]-|LS0tLS1CRUdJT|[sr]k_(?:test|live|prod)_|AIza|SG\.\w"
    r"|pplx-|pat[A-Za-z0-9]{14}\.|AGE-SECRET|ey[A-Za-z0-9]{17,}\.ey|sgp_|sl\.[A-Za-z0-9=_-]{20}|github_pat|glpat-|npm_|hf_|do[opr]_v1_|shp(?:at|ca|pa|ss)_|lin_api_|pypi-|PMAK-|[0-9]:AA"
)


def redacted(text: Column) -> Column:
    """Text without private keys, assigned secrets and known tokens; redacting twice changes nothing.

    One search for what every shape needs spares most texts the chain."""
    whole = text
    text = F.regexp_replace(text, PRIVATE_KEY, "[REDACTED:private-key]")
    text = F.regexp_replace(text, CUT_OFF_KEY, "$1[REDACTED:private-key]")
    text = F.regexp_replace(text, TABLE_ROW, "$1$2[REDACTED:secret]$2")
    text = F.regexp_replace(text, ASSIGNED, "$1$2$3[REDACTED:secret]$3")
    text = F.regexp_replace(text, TOLD, "$1$2$3[REDACTED:secret]$3")
    for shape, mark in TOKEN_SHAPES + VENDOR_SHAPES:
        text = F.regexp_replace(text, shape, mark)
    return F.when(whole.rlike(ANY_SHAPE), text).otherwise(whole)
