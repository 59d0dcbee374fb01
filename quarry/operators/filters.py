"""Which files are read, and what of them: i01-i13."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.folds import greedy_fill


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case, or an empty string; a name's leading dot starts no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def ignored_directory(path: Column) -> Column:
    """The first directory of the path that is never read, in lower case, or null."""
    inner = F.slice(parts(F.lower(path)), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    return F.get(F.filter(inner, lambda x: x.isin(config.IGNORED_DIRECTORIES)), 0)


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def ignored_pattern(path: Column) -> Column:
    """The first glob that the file name matches, or null."""
    name = F.lower(file_name(path))
    return F.coalesce(*[F.when(name.rlike(glob_regex(g)), F.lit(g)) for g in config.IGNORED_PATTERNS])


def language(path: Column) -> Column:
    """The language of the path's extension, or null: a literal map, as the table is fixed."""
    pairs = F.create_map(*[F.lit(x) for kv in config.LANGUAGE_OF.items() for x in kv])
    return F.try_element_at(pairs, extension(path))


def supported(path: Column) -> Column:
    return extension(path).isin(list(config.LANGUAGE_OF))


def filter_reason(path: Column, size: Column) -> Column:
    """`ok`, or why the file isn't read: the first failing test in order."""
    folder, glob, ext = ignored_directory(path), ignored_pattern(path), extension(path)
    too_large = F.concat(F.lit("file too large: "), F.format_number(size, 0), F.lit(f" bytes (limit: {config.MAX_FILE_BYTES:,} bytes)"))
    return (
        F.when(folder.isNotNull(), F.concat(F.lit("ignored directory: "), folder))
        .when(glob.isNotNull(), F.concat(F.lit("ignored pattern: "), glob))
        .when(~supported(path), F.concat(F.lit("unsupported extension: "), F.when(ext == "", "(no extension)").otherwise(ext)))
        .when(size > config.MAX_FILE_BYTES, too_large)
        .otherwise("ok")
    )


def likely_binary(content: Column) -> Column:
    """Whether the first characters hold too many NULs or unprintable ones (line feed, return and tab aside); empty text isn't binary."""
    head = F.substring(content, 1, config.BINARY_SAMPLE_CHARS)
    n = F.length(head)
    nul = n - F.length(F.regexp_replace(head, "\\x00", ""))
    # unprintable: all of Unicode's categories C (controls, formats, unassigned) and Z (separators) but for the space
    odd = n - F.length(F.regexp_replace(head, r"[\p{C}\p{Z}&&[^ \n\r\t]]", ""))
    return (n > 0) & ((nul / n > config.BINARY_NUL_SHARE) | (odd / n > config.BINARY_NONPRINTABLE_SHARE))


def byte_cap(files: DataFrame, key: str = "repo", budget: int = config.MAX_TOTAL_BYTES) -> DataFrame:
    """key, file_id, accepted, used of files in order of id, each accepted while its repository's total stays within the cap."""
    return greedy_fill(files, key, ["file_id"], "size_bytes", budget)


def longest_line(content: Column) -> Column:
    return F.array_max(F.transform(F.split(content, "\n"), F.length))


def parse_guard(content: Column) -> Column:
    """`empty`, `minified` (a line over the limit) or `parse`."""
    return F.when(F.length(content) == 0, "empty").when(longest_line(content) > config.MINIFIED_LINE_CHARS, "minified").otherwise("parse")


def truncated_body(body: Column) -> Column:
    return F.when(F.length(body) > config.MAX_BODY_CHARS, "[TRUNCATED]").otherwise(body)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def repo_url(raw: Column) -> Column:
    """owner, repo, branch and error of a repository's address: SSH, owner/repo, or a URL with or without scheme; error is null if all is well."""
    raw = F.trim(raw)
    # Address formats and name limits.
    ssh, short = r"(?i)^git@github\.com:([^/]+)/([^/]+?)(?:\.git)?$", r"^([a-zA-Z0-9][a-zA-Z0-9\-]{0,38})/([a-zA-Z0-9_.\-]+)$"
    owner_ok, repo_ok = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,37}[a-zA-Z0-9])?$", r"^[a-zA-Z0-9_.\-]+$"
    is_ssh = raw.rlike(ssh)
    is_short = raw.rlike(short) & ~raw.rlike("^(/|http|git)")
    bare = F.regexp_replace(raw, "^https?://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^.*@|:\d*$|\.$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    steps = F.filter(F.split(F.regexp_replace(path, r"\.git$", ""), "/"), lambda x: x != "")
    count = F.size(steps)
    url_error = (
        F.when(host.rlike("gitlab|bitbucket|codeberg|gitea"), "other host")
        .when((host != "") & ~host.isin("github.com", "www.github.com"), "unknown host")
        .when(count == 1, "user page").when(count < 2, "no repository")
    )
    plain = is_ssh | is_short
    owner = F.when(is_ssh, F.regexp_extract(raw, ssh, 1)).when(is_short, F.regexp_extract(raw, short, 1)).when(url_error.isNull(), F.get(steps, 0))
    repo = F.when(is_ssh, F.regexp_extract(raw, ssh, 2)).when(is_short, F.regexp_extract(raw, short, 2)).when(url_error.isNull(), F.get(steps, 1))
    repo = F.regexp_replace(repo, r"\.git$", "")
    branch = F.when(~plain & url_error.isNull() & (count >= 4) & F.get(steps, 2).isin("tree", "blob"), F.get(steps, 3))
    error = F.when(raw == "", "empty").when(~plain & url_error.isNotNull(), url_error).when((F.length(owner) > 39) | ~owner.rlike(owner_ok), "bad owner").when((F.length(repo) > 100) | ~repo.rlike(repo_ok), "bad name")
    return F.struct(owner.alias("owner"), repo.alias("repo"), branch.alias("branch"), error.alias("error"))
