"""URL and file-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def source_id(url: Column) -> Column:
    """The authority, or the path where there is none."""
    authority = F.regexp_extract(url, AUTHORITY, 1)
    return F.when(authority != "", authority).otherwise(path(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def defragmented(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def is_sitemap(url: Column) -> Column:
    return url.endswith("sitemap.xml") | path(url).contains("sitemap")


def is_text(url: Column) -> Column:
    return url.endswith(".txt")


def crawl_type(url: Column) -> Column:
    return F.when(is_text(url), "text_file").when(is_sitemap(url), "sitemap").otherwise("webpage")


def original_url(file_name: Column, prefix: str, site: str) -> Column:
    """The URL a saved page came from: known names map into a site, others are local."""
    stem = F.regexp_replace(file_name, r"\.html$", "")
    return F.when(stem.startswith(prefix), F.concat(F.lit(site), F.substring(stem, len(prefix) + 1, 1 << 20), F.lit(".html"))).otherwise(F.concat(F.lit("local://"), stem))


def page_file_name(url: Column) -> Column:
    name = F.regexp_replace(F.replace(path(url), F.lit("/"), F.lit("_")), r"^_+|_+$", "")
    return F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html")))


def safe_file_name(url: Column) -> Column:
    """<host>_<stem>_<eight digits of the URL's MD5>."""
    host = F.replace(F.regexp_extract(url, AUTHORITY, 1), F.lit("."), F.lit("_"))
    last = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(F.regexp_replace(last, r"\.html?$", ""), r"[^A-Za-z0-9_-]", "")
    stem = F.when(last == "", "index").when(stem == "", "page").otherwise(stem)
    return F.concat_ws("_", host, stem, F.substring(F.md5(url.cast("binary")), 1, 8))


def repo_name(url: Column) -> Column:
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".git"), F.lit(""))


def repo_url_check(url: Column) -> Column:
    """valid, error and repo_name of a repository URL."""
    blank = F.coalesce(F.trim(url), F.lit("")) == ""
    place = F.lower(url).contains("github.com") | url.endswith(".git")
    scheme = url.startswith("https://") | url.startswith("git@")
    error = F.when(blank, "a repository URL is required").when(~place, "not a repository URL").when(~scheme, "must begin with https:// or git@")
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), repo_name(url)).alias("repo_name"))


def blob_url(file: Column, root: str, repository: str, commit: str) -> Column:
    """A file under root as a link into the repository at a commit, others as file://."""
    inside = F.concat(F.lit(f"{repository.rstrip('/')}/blob/{commit}"), F.substring(file, len(root.rstrip("/")) + 1, 1 << 20))
    return F.when(file.startswith(root.rstrip("/") + "/"), inside).otherwise(F.concat(F.lit("file://"), file))
