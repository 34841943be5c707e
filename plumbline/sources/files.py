"""File sources: whole documents, path filters and the Markdown decision."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
MARKDOWN_EXTENSIONS = (".md", ".markdown", ".mdown", ".mkd")
EXTENSIONS = (*MARKDOWN_EXTENSIONS, ".txt")
SKIPPED_FOLDERS = (".git", "node_modules")
#: The name of ignore files.
IGNORE = ".plumblineignore"


def read_documents(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """(path, text) of whole files; carriage returns and a final newline stay."""
    rows = spark.read.option("recursiveFileLookup", recursive).text(paths, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def local_path(url: Column) -> Column:
    """The path of a file URL, without scheme and host, escapes resolved."""
    return F.url_decode(F.replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))


def read_folder(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = (), explicit: Iterable[str] = ()) -> DataFrame:
    """(path, text) of the documents below root, by path relative to it, and of explicit files, by their whole path.

    A file below root that is explicit too comes once, as explicit. The patterns meet file names alone, so the scan opens
    only the files that stay. Spark's readers pass over names that begin with _ or a dot.
    """
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    whole = local_path(F.col("_metadata.file_path"))
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    relative = F.substring(whole, F.lit(len(base) + 1), F.length(whole))
    explicit = list(dict.fromkeys(explicit))
    out = rows.where(walked(relative, include, exclude) & ~whole.isin(explicit)).select(relative.alias("path"), F.col("value").alias("text"))
    if explicit:
        out = out.unionByName(spark.read.text(explicit, wholetext=True).select(whole.alias("path"), F.col("value").alias("text")))
    return out


def glob_pattern(glob: str) -> str | None:
    """The anchored regular expression of a shell pattern in which * and ? never cross /; None for a bad pattern."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] == "^" else i + 1)
            inner = glob[i + 1 : end]
            if end < 0 or not inner.strip("^"):
                return None
            out += "[^/" + re.sub(r"([\[&~|\\])", r"\\\1", inner[1:]) + "]" if inner[0] == "^" else "[" + re.sub(r"([\[&~|\\])", r"\\\1", inner) + "]"
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """A pattern fits the whole path, its last part, or, after **/, the last part at any depth; bad patterns fit nothing."""
    base = F.regexp_extract(path, r"[^/]+$", 0)
    out = F.lit(False)
    for g in globs:
        if p := glob_pattern(g):
            out = out | F.rlike(path, F.lit(p)) | F.rlike(base, F.lit(p))
        if g.startswith("**/") and (p := glob_pattern(g[3:])):
            out = out | F.rlike(base, F.lit(p))
    return out


def walked(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a walk keeps a path: a known extension, no skipped or excluded folder above it, no exclude pattern, and an
    include pattern if there are any."""
    include, exclude = list(include), list(exclude)
    extension = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)).isin(*EXTENSIONS)
    folders = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    above = F.transform(folders, lambda f, i: F.array_join(F.slice(folders, F.lit(1), i + 1), "/"))
    skipped = F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS)) | F.exists(above, lambda a: (a != "") & matches_any(a, exclude))
    return extension & ~skipped & ~matches_any(path, exclude) & (matches_any(path, include) if include else F.lit(True))


def filter_paths(files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Distinct files(path[, explicit]) to read, sorted by path: explicit ones and those a walk keeps."""
    explicit = F.coalesce("explicit", F.lit(False)) if "explicit" in files.columns else F.lit(False)
    return files.where(explicit | walked(F.col("path"), include, exclude)).select("path").distinct().orderBy("path")


def is_markdown(path: Column, mode: str = "auto") -> Column:
    """on and off force it; auto decides by extension, in any case."""
    if mode in ("on", "off"):
        return F.lit(mode == "on")
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*MARKDOWN_EXTENSIONS)


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: blank lines and # comments are left out."""
    return [s for s in (x.strip() for x in text.splitlines()) if s and not s.startswith("#")]


def nearest(folder: str, names: Iterable[str]) -> Path | None:
    """The file of the first of the names that is found in a folder or, failing that, in the closest folder above it."""
    start, names = Path(folder).resolve(), list(names)
    return next((f for d in (start, *start.parents) for f in (d / n for n in names) if f.is_file()), None)


def ignored(folder: str, name: str = IGNORE) -> list[str]:
    """The exclude patterns of the ignore file that counts for a folder; none without such a file."""
    found = nearest(folder, [name])
    return ignore_patterns(found.read_text()) if found else []
