"""Source trees on disk or under git, as DataFrames of paths and contents."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.extract.languages import BUILT_IN, Language, language_of
from spandrel.functions.text import SKIP_DIRS, in_dirs, is_test_path

EXCLUDED = frozenset((*SKIP_DIRS[:10], ".hg", ".svn", ".idea", ".vscode", ".eggs", ".cache"))
IGNORE_FILE = ".spandrelignore"


class CheckoutError(RuntimeError):
    """A repository could not be read."""


def _git(root: Path, *args: str) -> str:
    got = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=120)
    if got.returncode:
        raise CheckoutError(got.stderr.strip()[:300])
    return got.stdout


def ignored(root: Path) -> frozenset[str]:
    """Names of directories that the tree's ignore file lists, one a line, ``#`` for comments."""
    f = root / IGNORE_FILE
    lines = f.read_text(errors="replace").splitlines() if f.is_file() else []
    return frozenset(x.strip().rstrip("/") for x in lines if x.strip() and not x.strip().startswith("#"))


def listing(root: str | Path, languages: tuple[Language, ...] = BUILT_IN) -> list[str]:
    """Sorted paths of a tree that some language claims: what git tracks or would track, else a walk."""
    root = Path(root)
    skip = EXCLUDED | ignored(root)
    paths: list[str] | None = None
    if (root / ".git").exists():
        try:
            paths = [p for p in _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0") if p]
        except (CheckoutError, OSError, subprocess.TimeoutExpired):
            paths = None
    if paths is None:
        paths = []
        for at, dirs, names in root.walk():
            dirs[:] = [d for d in dirs if d not in skip]
            paths += [(at / n).relative_to(root).as_posix() for n in names]
    return sorted({p for p in paths if language_of(p, languages) and not set(p.split("/")[:-1]) & skip and (root / p).is_file()})


def nested_repositories(root: str | Path) -> list[str]:
    """Directories inside a tree that are repositories of their own."""
    root = Path(root)
    return sorted(p.parent.relative_to(root).as_posix() for p in root.rglob(".git") if p.parent != root and not set(p.relative_to(root).parts[:-1]) & EXCLUDED)


def read_tree(spark: SparkSession, root: str | Path, languages: tuple[Language, ...] = BUILT_IN, paths: list[str] | None = None) -> DataFrame:
    """path, content, hash, size, mtime_ns of the listed files; a file that is no UTF-8 has a null content."""
    root = Path(root).resolve()
    paths = listing(root, languages) if paths is None else paths
    if not paths:
        return spark.createDataFrame([], "path string, content string, hash string, size long, mtime_ns long")
    raw = spark.read.format("binaryFile").load([f"file://{root}/{p}" for p in paths])
    return _decoded(raw, f"file:{root}/")


def read_directory(spark: SparkSession, url: str, skip: frozenset[str] = EXCLUDED) -> DataFrame:
    """The same for a whole directory on any file system, listed by Spark; excluded directories are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    base = url if "://" in url or url.startswith("file:") else f"file:{url}"
    got = _decoded(raw, base.rstrip("/").replace("file://", "file:") + "/")
    return got.filter(~in_dirs(F.col("path"), tuple(sorted(skip))))


def _decoded(raw: DataFrame, base: str) -> DataFrame:
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select(
        F.expr(f"substring(replace(path, 'file:///', 'file:/'), {len(base.replace('file:///', 'file:/')) + 1})").alias("path"),
        text.alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def candidates(files: DataFrame, suffix: str = ".py") -> DataFrame:
    """Paths of a language that are no tests and lie in no skipped directory."""
    return files.select("path").distinct().filter(F.col("path").endswith(suffix) & ~is_test_path(F.col("path")) & ~in_dirs(F.col("path"), SKIP_DIRS))


def modified(root: str | Path) -> list[str]:
    """Paths that git reports as changed or new in the working tree."""
    return sorted({line[3:].split(" -> ")[-1].strip('"') for line in _git(Path(root), "status", "--porcelain").splitlines() if line[:2].strip() not in ("", "D")})


def diff_since(root: str | Path, revision: str) -> str:
    """The working tree's diff against a revision; option-shaped or unknown revisions are refused."""
    if not revision or revision.startswith("-"):
        raise CheckoutError(f"no revision: {revision!r}")
    root = Path(root)
    _git(root, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}")
    return _git(root, "diff", "--no-color", revision)


def root_of(path: str | Path) -> Path:
    """The repository a path lies in, else its directory; never the home directory or ``/``."""
    at = Path(path).expanduser().resolve()
    at = at if at.is_dir() else at.parent
    try:
        at = Path(_git(at, "rev-parse", "--show-toplevel").strip())
    except (CheckoutError, OSError):
        pass
    if at in (Path.home(), Path("/")):
        raise CheckoutError(f"{at} is no repository")
    return at


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from JSON lines with a declared schema."""
    return spark.read.schema("instance_id string, repo string, base_commit string, problem_statement string, patch string").json(path)


def redacted(items: DataFrame) -> DataFrame:
    """Items without their gold patch, as arms may see them."""
    return items.drop("patch")
