"""Sources: folders of files, remote repositories, and what may be read."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import CONTENT_EXTENSIONS, DEFAULT_CONTENT, content_type_of, extension, language_of, slashed

MAX_FILE_BYTES = 1_000_000
#: Folders that are not entered.
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "dist", "build")
#: Schemes of remote sources.
REMOTE_SCHEMES = ("https://", "http://", "ssh://", "git://", "git+ssh://", "file://")


def is_remote(source: str) -> bool:
    """A URL with a known scheme, or ``user@host:path`` with a relative path."""
    return source.startswith(REMOTE_SCHEMES) or bool(re.match(r"[\w.-]+@[\w.-]+:[^/]", source, re.A))


def may_read(source: str) -> bool:
    """Local paths and https; http only if ``LODESTONE_ALLOW_HTTP_GIT`` is 1 or true."""
    if not is_remote(source) or source.startswith("https://"):
        return True
    return source.startswith("http://") and os.environ.get("LODESTONE_ALLOW_HTTP_GIT", "") in ("1", "true")


def in_workspace(source: str, workspace: str | None) -> bool:
    """Whether a local path lies in the workspace, links resolved; without a workspace all do."""
    if not workspace or is_remote(source):
        return True
    root, path = os.path.realpath(workspace), os.path.realpath(source)
    return os.path.commonpath([root, path]) == root


def resolve_content(kinds: Sequence[str] = ()) -> tuple[str, ...]:
    """Content types as given; ``all`` is every type, unknown ones are dropped, none given is the default."""
    if not kinds:
        return DEFAULT_CONTENT
    return tuple(CONTENT_EXTENSIONS) if "all" in kinds else tuple(k for k in kinds if k in CONTENT_EXTENSIONS)


def source_key(source: str, ref: str | None = None) -> str:
    """Hash that names a source's index: remote address with revision, or absolute path."""
    name = (f"{source}@{ref}" if ref else source) if is_remote(source) else os.path.abspath(source)
    return hashlib.sha256(name.encode()).hexdigest()


def clone(url: str, ref: str | None = None, timeout: int = 600) -> str:
    """A shallow copy of a remote repository in a new folder of the driver."""
    if not may_read(url):
        raise PermissionError(f"source not allowed: {url}")
    into = tempfile.mkdtemp(prefix="lodestone-clone-")
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, into], check=True, timeout=timeout, capture_output=True)
    return into


def is_repository(path: str) -> bool:
    return subprocess.run(["git", "-C", path, "rev-parse", "--is-inside-work-tree"], capture_output=True).returncode == 0


def top_level(path: str) -> str | None:
    done = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def _passes(path: Column, content: Sequence[str], folders_above: int = 0) -> Column:
    """The folder and extension filters on a path; the folders above the root of the scan do not count."""
    skipped = f"^(?:[^/]*/){{{folders_above}}}(?:.*/)?(?:" + "|".join(re.escape(f) for f in SKIPPED_FOLDERS) + ")/"
    return ~path.rlike(skipped) & extension(path).isin([e for kind in content for e in CONTENT_EXTENSIONS.get(kind, ())])


def accepted(files: DataFrame, content: Sequence[str] = DEFAULT_CONTENT, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Rows of a listing ``(file_path, size_bytes)`` that pass the folder, extension and size filters. A null size passes."""
    return files.where(_passes(slashed(F.col("file_path")), content) & (F.coalesce("size_bytes", F.lit(0)) <= max_bytes))


def read_folder(spark: SparkSession, root: str, content: Sequence[str] = DEFAULT_CONTENT, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``(file_path, ext, content_type, language, size_bytes, mtime_ms, text)`` of the readable files below a folder.

    The folder and extension filters stand on the file's metadata, so the planner
    drops files from the listing before any is opened; the size filter is pushed
    into the source. Blank files are left out. A folder that does not exist is an error.
    """
    if not re.match(r"[a-z0-9+]+:/", root):
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        root = "file://" + os.path.abspath(root)
    place = "/" + re.sub(r"^[a-z0-9+]+:/*", "", root).strip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    # metadata paths are escaped as in a URL, which changes neither slashes nor the letters looked for
    listed = raw.where(_passes(F.regexp_replace("_metadata.file_path", r"^[a-z0-9+]+:/+", "/"), content, place.count("/") + 1) & (F.col("length") <= max_bytes))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+]+:/+", "/"), f"^{re.escape(place)}/", "")
    files = listed.select(relative.alias("file_path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("text"))
    return files.where(F.length(F.trim(F.regexp_replace("text", r"\s", " "))) > 0).select(
        "file_path", extension(F.col("file_path")).alias("ext"), content_type_of(F.col("file_path")).alias("content_type"), language_of(F.col("file_path")).alias("language"), "size_bytes", "mtime_ms", "text"
    )
