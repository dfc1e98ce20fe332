"""Credentials in string values, properties and code lines: found and redacted.

Every block of values is indexed by trigrams (:mod:`skein.llm.trigram`); a detection rule is
run only on the values that hold the trigrams its expression requires. A match counts if the
captured value can be a secret in use: placeholders, masks, references and paths are none.
Nothing is shuffled but the findings.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.common import once
from skein.llm.trigram import Matcher

MASK = "[REDACTED]"

# Words that end the name of a secret, in code and configuration.
_NAME = (
    r"(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|encryption[_-]?key"
    r"|private[_-]?key|signing[_-]?key|auth[_-]?key|credentials?)"
)
#: A string literal may be cut in two and joined by a plus sign.
_JOIN = r"(?:[\"']\s*\+\s*[\"'])?"

# rule: (expression with the secret in group `v`, where it applies: values, code or both)
RULES: dict[str, tuple[str, str]] = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<v>(?:\\n|\\r|[\sA-Za-z0-9+/=:,-])*?)(?:-----END|$|[\"'])", "both"),
    "aws": (rf"(?<![A-Za-z0-9])(?P<v>A[KS]IA(?:[A-Z0-9]{_JOIN}){{16}})(?![A-Za-z0-9])", "both"),
    "github": (rf"(?<![A-Za-z0-9])(?P<v>gh[opsur]_(?:[A-Za-z0-9]{_JOIN}){{30,}})(?![A-Za-z0-9])", "both"),
    "gitlab": (rf"(?<![A-Za-z0-9])(?P<v>glpat-(?:[A-Za-z0-9_-]{_JOIN}){{16,}})", "both"),
    "slack": (rf"(?<![A-Za-z0-9])(?P<v>xox[abprs]-(?:[A-Za-z0-9-]{_JOIN}){{16,}})", "both"),
    "stripe": (rf"(?<![A-Za-z0-9])(?P<v>[sr]k_live_(?:[A-Za-z0-9]{_JOIN}){{16,}})(?![A-Za-z0-9])", "both"),
    "pat": (rf"(?<![A-Za-z0-9])(?P<v>[a-z]{{2,8}}_pat_(?:[A-Za-z0-9]{_JOIN}){{16,}})(?![A-Za-z0-9])", "both"),
    "jwt": (rf"(?<![A-Za-z0-9])(?P<v>eyJ(?:[A-Za-z0-9_-]{_JOIN}){{8,}}\.(?:[A-Za-z0-9_-]{_JOIN}){{8,}}\.(?:[A-Za-z0-9_-]{_JOIN}){{8,}})", "both"),
    "url_login": (r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,40}://[^/\s:@\"']*:(?P<v>[^@\s/\"']+)@", "both"),
    "url_param": (r"[?&](?:access_token|auth_token|token|api_?key|sig|signature|secret|password)=(?P<v>[^&\s\"'#]+)", "both"),
    "bearer": (r"\bbearer\s+(?P<v>[A-Za-z0-9._~+/=-]{12,})", "both"),
    "basic": (r"\bbasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])", "both"),
    "named": (rf"{_NAME}[\"']?\s*(?::=|=>|==?|:)\s*(?:[\"'](?P<v>[^\"']*)[\"']|(?P<w>[^\s\"',;&<>(){{}}]++)(?![^\s\"',;&]*\())", "values"),
    "assigned": (rf"{_NAME}[\"'\])]{{0,3}}\s*(?::=|=>|==?|:)\s*(?P<q>[\"'`])(?P<v>[^\"'`]+)(?P=q)", "code"),
    "login_call": (r"(?:login|basicauth|authenticate|credentials?)\w*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"'](?P<v>[^\"']+)[\"']", "both"),
    "setenv": (rf"setenv\(\s*[\"'][A-Za-z0-9_]*{_NAME}[\"']\s*,\s*[\"'](?P<v>[^\"']+)[\"']", "both"),
    "env_value": (r"\.env\.\d+\.value=(?P<v>.+)", "values"),
}
_ENV_NAME = re.compile(rf"^(.*\.env\.\d+)\.name=[\"']?[A-Za-z0-9_]*(?:{_NAME}|key)[\"']?$", re.I)
_ENV_VALUE = re.compile(r"^(.*\.env\.\d+)\.value=", re.I)

# What stands for a secret without being one.
_PLACEHOLDER = re.compile(
    r"(?:<.*>|\$\{.*|\$\(.*|\$[A-Z_]+|\{.*|.*\}\}?|%[a-z]|%\(.*|\*+|x{3,}|\.{2,}|-+|_+|0+|your[-_ ]?.*|.*[-_ ]here|change[-_ ]?(?:me|this|it)"
    r"|redacted|\[redacted\]|masked|hidden|todo|tbd|fixme|none|null|nil|undefined|true|false|empty|example.*|.*example|dummy.*|sample.*"
    r"|placeholder.*|fill[-_ ]?me.*|fill[-_ ]?in.*|test|password|passwd|passphrase|pwd|pass|secret|token|key|api[-_ ]?key|user|string|value"
    r"|(?:env|vault|file|ref|secret|ssm|arn|process\.env|os\.)[:.].*|secretref.*)",
    re.I,
)


def plausible(value: str, short: int = 4) -> bool:
    """Whether a captured value can be a secret in use."""
    v = value.strip().strip("\"'`")
    if len(v) < short or _PLACEHOLDER.fullmatch(v):
        return False
    if v[0] in "/~" or v.startswith(("./", "../")) or re.fullmatch(r"[A-Za-z]:\\.*", v):
        return False  # a path to it
    if re.search(r"([A-Za-z*#.])\1{5,}", v) or "EXAMPLE" in v:
        return False  # masked, or the documented example
    core = re.sub(r"[^A-Za-z0-9]", "", v)
    return len(set(core.lower())) >= 3


def _decoded(value: str) -> str | None:
    """The text behind base64, if it is some."""
    if len(value) < 8 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return None
    try:
        text = base64.b64decode(value, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if text.isprintable() else None


def _counts(rule: str, value: str, before: str | None, whole: str) -> bool:
    if rule == "private_key":
        return len(re.sub(r"[^A-Za-z0-9+/]", "", value.replace("\\n", "").replace("\\r", ""))) >= 24
    if rule == "basic":
        text = _decoded(value + "=" * (-len(value) % 4))
        return text is not None and ":" in text and plausible(text.partition(":")[2])
    if rule == "env_value":
        name, own = _ENV_NAME.match((before or "").strip()), _ENV_VALUE.match(whole.strip())
        if not name or not own or name[1] != own[1]:
            return False
    if rule in ("bearer", "url_param"):
        return plausible(value, 8)
    if rule in ("named", "assigned", "env_value"):
        hidden = _decoded(value)
        if hidden is not None and not plausible(hidden):
            return False
        # a lower-case word after a colon is a message, after an equals sign a name
        if re.fullmatch(r"[a-z]+", value) or re.fullmatch(r"\d{1,4}[a-z]?", value):
            return False
    return plausible(value)


class Detector:
    """All rules, compiled; finds the secrets of single values and of blocks of them."""

    def __init__(self):
        self.rules = {n: (re.compile(p, re.I), where) for n, (p, where) in RULES.items()}
        for strict in ("aws", "github", "gitlab", "slack", "stripe", "pat", "jwt"):
            self.rules[strict] = (re.compile(RULES[strict][0]), RULES[strict][1])
        self.matcher = Matcher({n: (p, 0) for n, (p, _) in RULES.items()})

    def spans(self, rule: str, text: str, before: str | None, code: bool) -> list[tuple[int, int]]:
        expression, where = self.rules[rule]
        if where == ("values" if code else "code"):
            return []
        out = []
        for m in expression.finditer(text):
            group = "v" if m.group("v") is not None else "w"
            if _counts(rule, m.group(group), before, text):
                out.append(m.span(group))
        return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with only the secrets replaced; a joint of two literals inside one is kept."""
    out, end = [], 0
    for a, b in sorted(spans):
        if b <= end:
            continue
        a = max(a, end)
        out.append(text[end:a])
        out.append(re.sub(r"([\"'])(\s*\+\s*)([\"'])", rf"\1\2\3{MASK}", MASK + re.sub(r"[^\"'+\s]+", "", text[a:b]) if re.search(r"[\"']\s*\+\s*[\"']", text[a:b]) else MASK))
        end = b
    return "".join(out) + text[end:]


_OUT = pa.schema([("tab", pa.string()), ("row_id", pa.int64()), ("field", pa.string()), ("pos", pa.int64()), ("rules", pa.string()), ("redacted", pa.string())])
_DETECTOR: Detector | None = None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _DETECTOR
    if _DETECTOR is None:
        _DETECTOR = Detector()
    for batch in batches:
        lists = batch.column("items")
        flat = lists.flatten().cast(pa.large_string())
        if not len(flat):
            continue
        at = np.asarray(pa.compute.list_parent_indices(lists))
        first = np.searchsorted(at, np.arange(batch.num_rows))
        filled = pa.compute.fill_null(flat, "")
        bounds = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        data = np.frombuffer(filled.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if filled.buffers()[2] is not None else np.empty(0, np.uint8)
        found: dict[int, list] = {}
        fields = batch.column("field")
        for rule, chunks in _DETECTOR.matcher.candidates(data, bounds - bounds[0]).items():
            for i in chunks.tolist():
                row = int(at[i])
                code = fields[row].as_py() == "ev_snippet"
                before = flat[i - 1].as_py() if i > first[row] else None
                for span in _DETECTOR.spans(rule, flat[i].as_py(), before, code):
                    found.setdefault(i, []).append((rule, span))
        if found:
            keys = sorted(found)
            rows = at[keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tab").take(pa.array(rows)), batch.column("row_id").take(pa.array(rows)), fields.take(pa.array(rows)),
                 pa.array([-1 if fields[int(r)].as_py() == "ev_snippet" else int(i - first[r]) for i, r in zip(keys, rows)], pa.int64()),
                 pa.array([",".join(sorted({r for r, _ in found[i]})) for i in keys]),
                 pa.array([redact(flat[i].as_py(), [s for _, s in found[i]]) for i in keys])],
                schema=_OUT,
            )


def find_secrets(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(tab, row_id, field, pos, rules, redacted) of every value that holds a secret.

    ``pos`` is the 0-based place in the array, -1 for a snippet. Null rows, arrays, elements
    and empty texts hold none. Of rows delivered again the latest by ``loaded_at`` counts, so
    a secret a later delivery no longer has isn't reported; rows of a null id are one. Values
    are scanned whole, however long.
    """
    entities = once(entities.select("ent_id", "literals", "properties", "loaded_at"), "ent_id")
    relationships = once(relationships.select("rel_id", "ev_snippet", "loaded_at"), "rel_id")
    parts = [
        entities.select(F.lit("entities").alias("tab"), F.col("ent_id").cast("long").alias("row_id"), F.lit(f).alias("field"), F.col(f).cast("array<string>").alias("items"))
        .filter("size(items) > 0")
        for f in ("literals", "properties")
    ]
    parts.append(
        relationships.filter("ev_snippet is not null").select(F.lit("relationships").alias("tab"), F.col("rel_id").cast("long").alias("row_id"), F.lit("ev_snippet").alias("field"), F.array("ev_snippet").alias("items"))
    )
    values = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return values.mapInArrow(_scan, "tab string, row_id long, field string, pos long, rules string, redacted string")
