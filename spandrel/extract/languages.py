"""Languages as data: which files a language claims and what its names mean across files; users add their own."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

KINDS = frozenset("function class state method interface type enum key variable resource output".split())
EDGES = frozenset("calls inherits reads writes types implements copies loads".split())
STRATEGIES = frozenset("lexical path name".split())


class LanguageError(ValueError):
    """A language record is wrong; the message names the field."""


@dataclass(frozen=True)
class Rule:
    """A regular expression whose named groups ``name`` or ``target`` are taken from the text."""

    kind: str
    pattern: str
    resolve: str = "lexical"
    only: tuple[str, ...] = ()
    unresolved: str = "external"


@dataclass(frozen=True)
class Language:
    name: str
    version: str
    globs: tuple[str, ...]
    reader: str = "rules"  # python, script, yaml, hcl or rules
    suffix: str = ""
    index: str = ""
    own: str = ""  # how a method calls its object
    entities: tuple[Rule, ...] = field(default=())
    references: tuple[Rule, ...] = field(default=())

    def claims(self, path: str) -> bool:
        base = path.rsplit("/", 1)[-1]
        return any(fnmatch.fnmatchcase(base, g) for g in self.globs)


BUILT_IN = (
    Language("python", "7", ("*.py",), "python", ".py", "__init__", "self"),
    Language("typescript", "3", ("*.ts",), "script", ".ts", "index", "this"),
    Language("tsx", "1", ("*.tsx",), "script", ".tsx", "index", "this"),
    Language("yaml", "1", ("*.yml", "*.yaml"), "yaml"),
    Language("dockerfile", "1", ("Dockerfile", "Dockerfile.*", "*.dockerfile"), references=(Rule("copies", r"(?im)^\s*COPY\s+(?:--\S+\s+)*(?P<target>[^\s\[\"]+)(?=\s+\S)", "path", (), "drop"),)),
    Language(
        "terraform", "1", ("*.tf",),
        entities=(Rule("variable", r'(?m)^[ \t]*variable\s+"(?P<name>[^"]+)"'), Rule("resource", r'(?m)^[ \t]*resource\s+"(?P<name>[^"]+)"\s+"(?P<name2>[^"]+)"'), Rule("output", r'(?m)^[ \t]*output\s+"(?P<name>[^"]+)"')),
    ),
    Language("html", "1", ("*.html", "*.htm"), references=(Rule("loads", r"""(?i)\b(?:src|href)\s*=\s*["'](?P<target>[^"']*)["']""", "path", (), "drop"),)),
)


def language(record: dict) -> Language:
    """A language from a plain record (as a YAML or JSON file holds it), checked field by field."""
    known = {"name", "version", "globs", "suffix", "index", "own", "entities", "references"}
    for key in record:
        if key not in known:
            raise LanguageError(f"unknown field {key!r}")
    for key in ("name", "version", "globs"):
        if not record.get(key):
            raise LanguageError(f"field {key!r} is missing")
    if isinstance(record["globs"], str) or not all(isinstance(g, str) for g in record["globs"]):
        raise LanguageError("field 'globs' must be a list of patterns")
    rules: dict[str, list[Rule]] = {"entities": [], "references": []}
    for part, kinds, group in (("entities", KINDS, "name"), ("references", EDGES, "target")):
        for i, r in enumerate(record.get(part, ())):
            at = f"{part}[{i}]"
            if r.get("kind") not in kinds:
                raise LanguageError(f"{at}.kind must be one of {', '.join(sorted(kinds))}")
            try:
                groups = re.compile(r.get("pattern", "")).groupindex
            except re.error as e:
                raise LanguageError(f"{at}.pattern: {e}") from e
            if group not in groups:
                raise LanguageError(f"{at}.pattern has no group {group!r}")
            if r.get("resolve", "lexical") not in STRATEGIES:
                raise LanguageError(f"{at}.resolve must be one of {', '.join(sorted(STRATEGIES))}")
            if r.get("unresolved", "external") not in ("external", "drop"):
                raise LanguageError(f"{at}.unresolved must be external or drop")
            if bad := set(r.get("only", ())) - KINDS:
                raise LanguageError(f"{at}.only: unknown kind {sorted(bad)[0]!r}")
            rules[part].append(Rule(r["kind"], r["pattern"], r.get("resolve", "lexical"), tuple(r.get("only", ())), r.get("unresolved", "external")))
    return Language(record["name"], str(record["version"]), tuple(record["globs"]), "rules", record.get("suffix", ""), record.get("index", ""), record.get("own", ""), tuple(rules["entities"]), tuple(rules["references"]))


def language_of(path: str, languages: tuple[Language, ...] = BUILT_IN) -> Language | None:
    """The first language that claims a path."""
    return next((x for x in languages if x.claims(path)), None)
