"""The rule table: schema, files, and a small core set.

A rule file is YAML (a list under `rules:`), JSON, or TOML with [[rules]]; its path is a parameter. A malformed
file is an error, never an empty rule set.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "id string, name string, category string, subcategory string, source string, confidence string, regex string, keywords array<string>, "
    "entropy double, tags array<string>, checksum_type string, replacement_type string, description string, severity string, literal_prefix string, exclude_regex string"
)
CATEGORIES, CONFIDENCES = ("secret", "pii", "infra"), ("high", "medium", "low")


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str
    name: str = ""
    category: str = "secret"
    subcategory: str = "generic"
    source: str = "own"
    confidence: str = "medium"
    keywords: tuple[str, ...] = ()
    entropy: float | None = None
    tags: tuple[str, ...] = ()
    checksum_type: str | None = None
    replacement_type: str = "generic_random"
    description: str = ""
    severity: str = "medium"
    literal_prefix: str | None = None
    exclude_regex: str | None = None

    def __post_init__(self):
        if self.category not in CATEGORIES or self.confidence not in CONFIDENCES or self.checksum_type not in (None, "luhn"):
            raise ValueError(f"rule {self.id}: unknown category, confidence or checksum")


#: Our own rules, in the subset of patterns that all engines read alike.
CORE = (
    Rule("card", "4[0-9]{15}", category="pii", subcategory="cc", confidence="high", checksum_type="luhn", replacement_type="faker_cc_luhn", severity="high"),
    Rule("email", r"[a-z0-9._-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]+", category="pii", subcategory="email", confidence="high", keywords=("@",), replacement_type="faker_email", severity="high"),
    Rule("hex40", "[0-9a-f]{40}", subcategory="generic", entropy=3.0, replacement_type="faker_api_key"),
    Rule("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", category="infra", subcategory="ipv4", confidence="low", replacement_type="passthrough", severity="low"),
    Rule("phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", category="pii", subcategory="phone", confidence="high", replacement_type="faker_phone", severity="high"),
    Rule("token", r'token = "[0-9a-f]{40}"', subcategory="generic", confidence="high", keywords=("token",), replacement_type="faker_api_key", severity="high", literal_prefix='token = "'),
)


def _clean(found: dict) -> Rule:
    known = {f.name for f in fields(Rule)}
    values = {k: v for k, v in found.items() if k in known and v is not None}
    for k in ("keywords", "tags"):
        if k in values:
            values[k] = tuple(values[k])
    if "entropy" in values:
        values["entropy"] = float(values["entropy"])
    if "id" not in values or "regex" not in values:
        raise ValueError(f"a rule without id or regex: {found}")
    return Rule(**values)


def parse_yaml(text: str):
    """With PyYAML where it is installed, else the plain subset that rule files use."""
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text)


def _scalar(v: str):
    v = v.strip()
    if v in ("", "null", "~"):
        return None
    if v == "[]":
        return []
    if v[0] == "'" and v[-1] == "'" and len(v) > 1:
        return v[1:-1].replace("''", "'")
    if v[0] == '"' and v[-1] == '"' and len(v) > 1:
        return json.loads(v)
    return v


def _plain_yaml(text: str) -> dict:
    """rules: a list of mappings whose values are scalars, block scalars or lists of scalars."""
    rules: list[dict] = []
    lines = text.splitlines()
    i, key = 0, None
    while i < len(lines):
        line = lines[i]
        body = line.strip()
        i += 1
        if not body or body.startswith("#") or body == "rules:":
            continue
        indent = len(line) - len(line.lstrip())
        if body.startswith("- ") and ":" in body and (not rules or indent <= rules[-1]["_at"]):
            rules.append({"_at": indent})
            body = body[2:]
        elif body.startswith("- ") and key:
            rules[-1].setdefault(key, [])
            rules[-1][key] = [*(rules[-1][key] or []), _scalar(body[2:])]
            continue
        key, _, value = body.partition(":")
        if value.strip() in ("|", "|-", ">", ">-"):
            block = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > rules[-1]["_at"] + 2):
                block.append(lines[i].strip())
                i += 1
            rules[-1][key] = "\n".join(block)
        else:
            rules[-1][key] = _scalar(value)
    return {"rules": [{k: v for k, v in r.items() if k != "_at"} for r in rules]}


def load(path: str, required: tuple[str, ...] = ()) -> list[Rule]:
    """Rules of a YAML, JSON or TOML file, sorted by id. A file without one of the required ids is an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".toml"):
        import tomllib

        found = tomllib.loads(text)
    elif path.endswith(".json"):
        found = json.loads(text)
    else:
        found = parse_yaml(text)
    rules = found.get("rules") if isinstance(found, dict) else None
    if not rules:
        raise ValueError(f"{path}: no rules")
    out = sorted((_clean(r) for r in rules), key=lambda r: r.id.encode())
    if len({r.id for r in out}) != len(out):
        raise ValueError(f"{path}: ids repeat")
    if missing := sorted(set(required) - {r.id for r in out}):
        raise ValueError(f"{path}: no rule {', '.join(missing)}")
    return out


def frame(spark: SparkSession, rules=CORE) -> DataFrame:
    """The rule table as a DataFrame; a small dimension of a known size."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [tuple(list(v) if isinstance(v := asdict(r)[n], tuple) else v for n in names) for r in rules]
    return spark.createDataFrame(rows, SCHEMA)


# ---- upstream formats --------------------------------------------------------------------


def parse_toml_rules(text: str) -> list[dict]:
    """[[rules]] with id, description, regex, entropy, keywords, tags; rules for paths only are skipped."""
    import tomllib

    out = []
    for r in tomllib.loads(text).get("rules", []):
        if r.get("regex"):
            out.append({"id": r["id"], "name": r["id"], "description": r.get("description", ""), "regex": r["regex"], "entropy": r.get("entropy"), "keywords": r.get("keywords", []), "tags": r.get("tags", [])})
    return out


def parse_pattern_list(text: str) -> list[dict]:
    """`- pattern:` entries with name, regex and confidence, by lines; none at all is an error."""
    out: list[dict] = []
    for line in text.splitlines():
        body = line.strip().removeprefix("- ")
        key, _, value = body.partition(":")
        if key == "name":
            out.append({"name": _scalar(value)})
        elif key in ("regex", "confidence") and out:
            out[-1][key] = _scalar(value)
    out = [r for r in out if r.get("regex")]
    if not out:
        raise ValueError("no patterns")
    return out


def parse_example_rules(text: str, longest: int = 500) -> list[dict]:
    """Rules with id, name, pattern, categories and examples; examples over `longest` characters are left out."""
    out = []
    for r in (parse_yaml(text) or {}).get("rules", []):
        if r.get("id") and r.get("pattern"):
            short = lambda k, r=r: [e for e in r.get(k) or [] if len(e) <= longest]
            out.append({"id": r["id"], "name": r.get("name", ""), "regex": r["pattern"].strip(), "categories": r.get("categories") or [], "examples": short("examples"), "negative_examples": short("negative_examples")})
    return out


# ---- pattern text ------------------------------------------------------------------------


def strip_comments(pattern: str) -> str:
    """Without (?# ...) comments, whose parentheses may nest."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("(?#", i):
            depth, i = 1, i + 3
            while i < len(pattern) and depth:
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 1
        else:
            if pattern[i] == "\\" and i + 1 < len(pattern):
                out.append(pattern[i])
                i += 1
            out.append(pattern[i])
            i += 1
    return "".join(out)


def for_java(pattern: str) -> str:
    """The pattern in Java's dialect: comments out, POSIX classes and named groups renamed."""
    import re

    pattern = strip_comments(pattern).replace("(?P<", "(?<")
    names = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "digit": "0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"\p{Punct}", "xdigit": "0-9A-Fa-f", "word": r"\w"}
    return re.sub(r"\[:(\w+):\]", lambda m: names[m[1]], pattern)


def common_prefix(words: list[str]) -> str:
    if not words:
        return ""
    low, high = min(words), max(words)
    k = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:k]


_LITERAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def literal_prefix(pattern: str) -> str | None:
    """The literal text that every match begins with, as far as it is certain; None if shorter than 2."""

    def head(p: str) -> str:
        while True:
            for skip in ("^", r"\b", r"\A", "(?i)", "(?m)", "(?s)", "(?x)", "(?-u)"):
                if p.startswith(skip):
                    p = p[len(skip) :]
                    break
            else:
                break
        if p.startswith("(") and not p.startswith("(?") or p.startswith("(?:"):
            body = p[3:] if p.startswith("(?:") else p[1:]
            depth, cut, parts, i = 0, 0, [], 0
            while i < len(body):
                ch = body[i]
                if ch == "\\":
                    i += 2
                    continue
                if ch == "[":
                    end = body.find("]", i + 2)
                    i = end + 1 if end > 0 else len(body)
                    continue
                if ch == "(":
                    depth += 1
                elif ch == ")" and depth == 0:
                    break
                elif ch == ")":
                    depth -= 1
                elif ch == "|" and depth == 0:
                    parts.append(body[cut:i])
                    cut = i + 1
                i += 1
            parts.append(body[cut:i])
            rest = body[i + 1 :]
            if rest[:1] in ("?", "*", "{"):
                return ""
            if len(parts) > 1:
                return common_prefix([head(x) for x in parts])
            inner = head(parts[0])
            return inner + head(rest) if inner == parts[0] else inner
        out, i = "", 0
        while i < len(p):
            ch = p[i]
            if ch == "\\" and i + 1 < len(p) and not p[i + 1].isalnum():
                ch, step = p[i + 1], 2
            elif ch in _LITERAL:
                step = 1
            else:
                break
            if p[i + step : i + step + 1] in ("?", "*", "{", "+"):
                break
            out += ch
            i += step
        if "|" in p[i : i + 1]:
            return ""
        return out

    found = head(pattern)
    return found if len(found) >= 2 else None
