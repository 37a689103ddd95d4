"""Rule files, ignore files and settings keys: small texts, read on the driver."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_rules(text: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(whole-word variants, regex rules) of a TOML text; a pattern that does not compile raises ValueError."""
    data = tomllib.loads(text)
    rules = [(r["pattern"], r["replace"]) for r in data.get("rules", [])]
    for pattern, _ in rules:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    return dict(data.get("variants", {})), rules


def slashed_pattern(pattern: str) -> str:
    """``/expression/`` and ``/expression/i`` as regular expressions, anything else as its literal text."""
    m = re.fullmatch(r"/(.*)/([^/]*)", pattern, re.DOTALL)
    if not m:
        return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", pattern)
    if m[2].strip("i"):
        raise ValueError(f"unsupported flags {m[2]!r}")
    return ("(?i)" if m[2] else "") + m[1]


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression for relative paths, whether it takes back) of an ignore file, in its order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        glob = line[1:] if back else line
        folder, glob = glob.endswith("/"), glob.rstrip("/")
        anchored, glob = "/" in glob, glob.lstrip("/")
        body = ""
        for part in re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?)", glob):
            body += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        out.append(("^" + ("" if anchored else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + "$", back))
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches a relative path decides."""
    return F.coalesce(*[F.when(path.rlike(pattern), F.lit(not back)) for pattern, back in reversed(rules)], F.lit(False))


def nearest_key(key: Column, allowed: list[str]) -> Column:
    """The first of the nearest allowed keys, if no more than max(3, a third of the key's length) edits away."""
    every = F.array(*[F.struct(F.levenshtein(key, F.lit(a)).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("key")) for i, a in enumerate(allowed)])
    best = F.array_min(every)
    return F.when(best["d"] <= F.greatest(F.lit(3), F.floor(F.length(key) / 3)), best["key"])


def import_typos(text: str) -> tuple[dict[str, str], list[str]]:
    """(words, untranslated keys) of a TOML settings file with [default.extend-words]."""
    data, left = tomllib.loads(text), []
    words = data.get("default", {}).get("extend-words", {})
    for name, value in data.items():
        if name != "default":
            left.append(name)
        else:
            left += [f"default.{k}" for k in value if k != "extend-words"]
    return dict(words), sorted(left)


def import_word_settings(settings: dict) -> tuple[list[str], list[str], list[str]]:
    """(allowed words, excluded globs, untranslated keys) of JSON settings with words, ignoreWords and ignorePaths."""
    words = [w for k in ("words", "ignoreWords") for w in settings.get(k, [])]
    left = sorted(k for k in settings if k not in ("words", "ignoreWords", "ignorePaths", "version", "$schema"))
    return words, list(settings.get("ignorePaths", [])), left
