"""Column expressions over names, paths and identifiers; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a path a test, what directories hold no candidate sources, and what ends a reference.
TEST_DIRS = ("tests", "test", "testing")
SKIP_DIRS = (
    ".git", ".venv", "venv", "node_modules", "__pycache__", ".tox", "build", "dist", ".mypy_cache", ".pytest_cache",
    "site-packages", "doc", "docs", "examples", "benchmarks",
)
LONGEST_REFERENCE = 1024
WORD, CAMEL = "([A-Za-z_][A-Za-z0-9_]*)", "([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"


def tokens(text: Column) -> Column:
    """Identifier-aware terms: each word in lower case, and the parts of its camel case and of its underscores if
    there are several of two letters or more."""

    def parts(w: Column) -> Column:
        camel = F.filter(F.regexp_extract_all(w, F.lit(CAMEL), F.lit(1)), lambda p: F.length(p) > 1)
        snake = F.filter(F.split(F.lower(w), "_"), lambda p: F.length(p) > 1)
        several = F.transform(F.array(camel, snake), lambda a: F.when(F.size(a) > 1, F.transform(a, F.lower)).otherwise(F.array().cast("array<string>")))
        plain = (F.lower(w) == w) & ~F.contains(w, F.lit("_"))  # one part by either
        return F.when(plain, F.array(w)).otherwise(F.concat(F.array(F.lower(w)), F.flatten(several)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), parts))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tail(name: Column) -> Column:
    """The last part of a dotted name."""
    return F.element_at(F.split(name, "\\."), -1)


def is_test_path(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    base = base_name(path)
    return F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | base.startswith("test_") | base.endswith("_test.py") | (base == "conftest.py")


def in_dirs(path: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the directories above a path has one of the names."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*map(F.lit, names)))


def path_reference(text: Column) -> Column:
    """The file that a reference names, query and fragment cut off; null if it names none (a scheme, another host,
    an anchor, white space, or too long)."""
    t = F.trim(text)
    bad = (t == "") | (F.length(t) > LONGEST_REFERENCE) | t.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:") | t.rlike("^(//|#|\\?)") | t.rlike("\\s")
    cut = F.split(F.split(t, "#")[0], "\\?")[0]
    return F.when(~bad & (cut != ""), cut)


def normal_path(text: Column, source: Column) -> Column:
    """A relative reference as a path from the root, ``.`` and ``..`` folded; null if it leaves the tree or starts at ``/``."""
    above = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1)
    steps = F.filter(F.concat(above, F.split(text, "/")), lambda p: (p != "") & (p != "."))
    up = F.lit("..")
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == up) & (F.size(acc) > 0) & (F.element_at(acc, -1) != up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(~text.startswith("/") & (F.size(folded) > 0) & (F.coalesce(F.get(folded, F.lit(0)), up) != up), F.array_join(folded, "/"))


def module_path(module: Column, source: Column, suffix: Column) -> Column:
    """The file a dotted module stands for; leading dots count directories from the source's. '' if it leaves the tree."""
    dots = F.length(F.regexp_extract(module, "^(\\.*)", 1))
    rest = F.replace(F.regexp_replace(module, "^\\.+", ""), F.lit("."), F.lit("/"))
    above = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1)
    up = dots - 1
    base = F.when(up <= F.size(above), F.slice(above, F.lit(1), F.greatest(F.size(above) - up, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.filter(F.concat(base, F.array(rest)), lambda p: p != ""), "/")
    return F.when(dots == 0, F.concat(rest, suffix)).otherwise(F.when(joined != "", F.concat(joined, suffix)).otherwise(F.lit("")))
