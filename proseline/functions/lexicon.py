"""Lexicons: phrases, patterns and exceptions per language and rule, and what they compile to."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from proseline.functions.kernel import WS

#: Letters that a trailing star stands for at most.
INFLECTION = 4


def phrase_pattern(phrase: str) -> str:
    """A regular expression for a phrase: any white space between words, either apostrophe, a star for an inflected end."""
    stem, star = (phrase[:-1], True) if phrase.endswith("*") else (phrase, False)
    words = ["".join("['’]" if c in "'’" else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", c) for c in w) for w in stem.split()]
    return rf"(?<![\p{{L}}\p{{N}}_]){f'{WS}+'.join(words)}{rf'\p{{L}}{{0,{INFLECTION}}}' if star else ''}(?![\p{{L}}\p{{N}}_])"


def quick_phrase(phrase: str) -> str:
    """phrase_pattern() with its first letter tried before what must not stand before it: the same matches."""
    pattern = phrase_pattern(phrase)
    first = re.match(r"\['’\]|\\.|.", pattern.removeprefix(r"(?<![\p{L}\p{N}_])"), re.S)
    return f"(?={first[0]}){pattern}" if phrase.strip(" *") else pattern


@dataclass(frozen=True)
class Entry:
    """A phrase or a pattern; hits that overlap one of `unless` wholly don't count.

    needs are lower-case strings without which a pattern can't match, quick
    is a pattern with the same matches that is found faster, and sure one that
    every text with a match holds; they save time only, and are no part of a
    lexicon's identity.
    """

    source: str
    kind: str = "phrase"
    unless: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    quick: str = ""
    sure: str = ""

    @property
    def literals(self) -> tuple[str, ...]:
        if self.kind == "pattern":
            return self.needs
        return (max(re.split(r"[\s'’*]+", self.source.lower()), key=len),)

    @property
    def pattern(self) -> str:
        body = quick_phrase(self.source) if self.kind == "phrase" else (self.quick or self.source).replace(r"\s", WS)
        return f"(?iu){body}"

    @property
    def unless_pattern(self) -> list[str]:
        return [f"(?iu){quick_phrase(p)}" for p in self.unless]


@dataclass(frozen=True)
class Lexicon:
    language: str
    version: str = "1"
    entries: dict[str, tuple[Entry, ...]] = field(default_factory=dict)
    exceptions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Start of the digest of the content that the lexicon was read from, which has examples too.
    digest: str | None = None

    def of(self, rule: str) -> tuple[Entry, ...]:
        return self.entries.get(rule, ())

    def identity(self) -> str:
        """Version and the start of the content's SHA-256."""
        return f"{self.version}+{self.digest or content_digest(self.content())[:12]}"

    def content(self) -> dict:
        """The lexicon as parsed YAML has it, without examples."""
        out: dict = {"version": self.version, "language": self.language, "phrases": {}, "patterns": {}, "exceptions": {k: [{"phrase": x} for x in v] for k, v in self.exceptions.items()}}
        for rule, entries in self.entries.items():
            for e in entries:
                out["phrases" if e.kind == "phrase" else "patterns"].setdefault(rule, []).append({e.kind: e.source, "except": list(e.unless)})
        return out


def canonical_entry(kind: str, item: dict) -> dict:
    """An entry with its examples, defaults filled in, its fields in their fixed order."""
    fixed = {"matches": item.get("matches"), "alsoMatches": list(item.get("alsoMatches") or ())}
    if item.get("doesNotMatch") is not None:
        fixed["doesNotMatch"] = item["doesNotMatch"]
    return {k: v for k, v in fixed.items() if v is not None} | {"except": list(item.get("except") or ()), kind: item[kind]}


def content_digest(content: dict) -> str:
    """SHA-256 of a canonical form of parsed YAML: the order of rules plays no part, that of entries and exceptions does."""
    entries = lambda section, kind: [[rule, [canonical_entry(kind, x) for x in items]] for rule, items in sorted((content.get(section) or {}).items())]
    form = {"version": str(content.get("version", "1")), "language": content["language"], "phrases": entries("phrases", "phrase"), "patterns": entries("patterns", "pattern"), "exceptions": [[rule, items] for rule, items in sorted((content.get("exceptions") or {}).items())]}
    return hashlib.sha256(json.dumps(form, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def parse_lexicon(content: dict, language: str | None = None) -> Lexicon:
    """A lexicon from parsed YAML: version, language, phrases and patterns by rule, exceptions by rule. Unknown shapes raise ValueError."""
    if set(content) - {"version", "language", "phrases", "patterns", "exceptions"}:
        raise ValueError(f"unknown sections: {sorted(set(content) - {'version', 'language', 'phrases', 'patterns', 'exceptions'})}")
    if content.get("language") not in ("sr", "en") or language not in (None, content["language"]):
        raise ValueError(f"wrong language: {content.get('language')}")
    entries: dict[str, list[Entry]] = {}
    for section, kind in (("phrases", "phrase"), ("patterns", "pattern")):
        for rule, items in (content.get(section) or {}).items():
            for item in items:
                if not isinstance(item, dict) or not item.get(kind):
                    raise ValueError(f"{section} of {rule}: no {kind}")
                entries.setdefault(rule, []).append(Entry(item[kind], kind, tuple(item.get("except") or ())))
    exceptions = {rule: tuple(x["phrase"] if isinstance(x, dict) else x for x in items) for rule, items in (content.get("exceptions") or {}).items()}
    return Lexicon(content["language"], str(content.get("version", "1")), {k: tuple(v) for k, v in entries.items()}, exceptions, content_digest(content)[:12])


def load_lexicon(path: str, language: str | None = None) -> Lexicon:
    import yaml

    with open(path, encoding="utf-8") as file:
        return parse_lexicon(yaml.safe_load(file), language)
