"""Expressions over object and file paths.

A project tree is ``<root>/<project>/{config,metadata,html,pdf,log}/<file>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names of a project and of a bucket.
PROJECT_DIRS = ("config", "metadata", "html", "pdf")
BUCKET_DIRS = ("log", "config", "pdf", "html", "metadata")


def _under(root: str, *parts: Column | str) -> Column:
    """Join parts below a root that may or may not end with a slash."""
    head = root if root == "" or root.endswith("/") else root + "/"
    tail = [F.lit(p) if isinstance(p, str) else p for p in parts]
    pieces: list[Column] = [F.lit(head)]
    for i, part in enumerate(tail):
        pieces += [part] if i == 0 else [F.lit("/"), part]
    return F.concat(*pieces)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def object_path(root: str, bucket: Column, key: Column) -> Column:
    return _under(root, bucket, key)


def project_name(root: str, path: Column) -> Column:
    """First non-empty segment once the root is taken out; null if none."""
    rest = F.replace(path, F.lit(root), F.lit("")) if root else path
    return F.try_element_at(F.filter(F.split(rest, "/"), lambda s: s != ""), F.lit(1))


def project_dir(root: str, path: Column, name: str) -> Column:
    return _under(root, project_name(root, path), name)


def project_dirs(root: str, path: Column) -> Column:
    """Struct of the four work folders of the path's project."""
    return F.struct(*[project_dir(root, path, d).alias(d) for d in PROJECT_DIRS])


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def config_log_path(path: Column) -> Column:
    """Log of a config file: suffix and every ``config`` in the path change."""
    return _swap(
        path, (".json", ".log"), (".yaml", ".log"), (".bib", ".log"), ("config", "log")
    )


def bib_log_path(path: Column) -> Column:
    return _swap(path, (".bib", ".log"), ("config", "log"))


def destination_path(root: str, path: Column) -> Column:
    """Metadata file a config leads to; null when the format is not known."""
    name = base_name(path)
    kind = config_format(path)
    target = (
        F.when(kind == "json", name)
        .when(kind == "yaml", _swap(name, (".yaml", ".json")))
        .when(kind == "bib", _swap(name, (".bib", ".json")))
    )
    return F.concat(project_dir(root, path, "metadata"), F.lit("/"), target)


def pdf_log_path(root: str, path: Column) -> Column:
    name = _swap(base_name(path), (".pdf", ".log"))
    return F.concat(project_dir(root, path, "log"), F.lit("/"), name)


def html_name(pdf_name: Column) -> Column:
    return _swap(pdf_name, (".pdf", ".html"))


def html_path(pdf_path: Column) -> Column:
    """Every ``pdf`` in the path becomes ``html``, folders too."""
    return _swap(pdf_path, ("pdf", "html"))


def config_format(path: Column) -> Column:
    """``json``, ``yaml``, ``bib`` or ``invalid``. The last two need no dot."""
    return (
        F.when(F.endswith(path, F.lit(".json")), "json")
        .when(F.endswith(path, F.lit("yaml")), "yaml")
        .when(F.endswith(path, F.lit("bib")), "bib")
        .otherwise("invalid")
    )


def is_watched(path: Column, strict: bool = False) -> Column:
    """Paths the folder watcher reacts to, in any letter case.

    By default the suffix may stand anywhere in the path; ``strict`` asks for
    it at the end.
    """
    # Watched suffixes, and the storage server's own files.
    suffix = r"(?i)\.(json|pdf|bib|yaml|yml)" + ("$" if strict else "")
    ignored = r"(?i)\.gitkeep|\.minio.sys"
    return path.rlike(suffix) & ~path.rlike(ignored)


def route_path(root: str, path: Column, strict: bool = False) -> Column:
    """``pdf``, ``config`` or ``ignored``.

    By default a folder is matched by prefix, so ``pdf_old/x.pdf`` counts as
    ``pdf``; ``strict`` asks for the slash after it.
    """
    end = "/" if strict else ""

    def inside(name: str) -> Column:
        return F.startswith(path, F.concat(project_dir(root, path, name), F.lit(end)))

    hidden = F.startswith(project_name(root, path), F.lit(".")) | F.startswith(
        base_name(path), F.lit(".")
    )
    return (
        F.when(project_name(root, path).isNull() | hidden, "ignored")
        .when(inside("pdf") & F.endswith(path, F.lit(".pdf")), "pdf")
        .when(inside("config"), "config")
        .otherwise("ignored")
    )


def document_name(url: Column, content: Column) -> Column:
    """Content hash plus the last twenty characters of the address."""
    name = F.regexp_replace(base_name(url), "#view=.+", "")
    return F.concat(F.md5(content), F.lit("-"), F.right(name, F.lit(20)))
