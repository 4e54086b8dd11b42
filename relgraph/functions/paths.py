"""Path rules: portability, ignore policy, secrets, languages, config files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from relgraph.functions.text import last_part

# ---- fixed values -------------------------------------------------------------
ANY_DEPTH_DIRECTORIES = {
    "bin": "build_output",
    "obj": "build_output",
    "node_modules": "dependency_cache",
    ".git": "version_control_metadata",
}
ROOT_DIRECTORIES = {
    ".staging": "staging_area",
    "queue": "queue_state",
    "leases": "queue_state",
    "locks": "queue_state",
    "logs": "log_file",
    "backups": "backup_artifact",
    "temp": "staging_area",
    "credentials": "credential_store",
}
IGNORED_EXTENSIONS = {
    "db": "database_file",
    "db-wal": "database_file",
    "db-shm": "database_file",
    "sqlite": "database_file",
    "sqlite3": "database_file",
    "wal": "database_file",
    "shm": "database_file",
    "log": "log_file",
    "swp": "editor_temporary_file",
    "tmp": "editor_temporary_file",
    "orig": "editor_temporary_file",
    "rej": "editor_temporary_file",
}
OUTPUT_ROOT = "live"
SECRET_DIRECTORIES = [".secrets", "secrets", "credentials"]
SECRET_NAMES = [".env", "credentials", "credentials.json", "secrets.json", "id_rsa", "id_ed25519",
                ".npmrc", ".pypirc", ".netrc"]
SECRET_EXTENSIONS = ["pfx", "p12", "key", "pem", "kdbx"]
LANGUAGE_OF_EXTENSION = {"cs": "csharp", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
                         "cts": "typescript"}
DEVICE_STEMS = (["CON", "PRN", "AUX", "NUL"]
                + [f"{port}{n}" for port in ("COM", "LPT") for n in "123456789¹²³"])
MAX_PATH_BYTES = 4096
MAX_SEGMENT_BYTES = 255
SHARED_BUILD_FILES = ["directory.build.props", "directory.build.targets"]
PACKAGE_LOCK_FILES = ["directory.packages.props", "nuget.config", "packages.lock.json", "package-lock.json",
                      "pnpm-lock.yaml", "yarn.lock", "bun.lockb"]
PACKAGE_MANIFEST_FILES = ["package.json", "pyproject.toml"]
ROUTE_FILES = ["routes.json", "endpoints.json"]
SOLUTION_SCOPED = ["solution_file", "shared_build_config"]
# -------------------------------------------------------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, or null."""
    mapping = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.try_element_at(mapping, key)


def _first(*columns: Column) -> Column:
    return F.coalesce(*columns)


def extension(path: Column) -> Column:
    """Text after the last dot of the last segment, or null without a dot."""
    name = last_part(path, "/")
    return F.when(F.contains(name, F.lit(".")), last_part(name, "."))


def portable_path(path: Column) -> Column:
    """``struct<path, reason>``: exactly one of the two is set for a non-null input."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.get(F.filter(F.split(unified, "/"), lambda s: s.isin("", ".", "..")), F.lit(0))
    reason = (
        F.when(path == "", "path-empty")
        .when(F.contains(path, F.lit("\x00")), "path-nul")
        .when(unified.rlike(r"^(?:/|[A-Za-z]:)"), "path-absolute")
        .when(bad == "", "path-empty-segment")
        .when(bad.isNotNull(), "path-traversal")
    )
    return F.struct(F.when(reason.isNull(), unified).alias("path"), reason.alias("reason"))


def strict_path_reason(path: Column) -> Column:
    """Null for a path that is portable to every platform, else the first reason against it."""
    segments = F.split(path, "/")

    def segment_reason(s: Column) -> Column:
        stem = F.upper(F.substring_index(s, ".", 1))
        return (
            F.when(s == "", "path-empty-segment")
            .when(s.isin(".", ".."), "path-traversal")
            .when(F.octet_length(s) > MAX_SEGMENT_BYTES, "path-segment-too-long")
            .when(s.rlike(r"[. ]$"), "path-trailing-dot-or-space")
            .when(F.contains(s, F.lit(":")), "path-stream-syntax")
            .when(stem.isin(*DEVICE_STEMS), "path-reserved-name")
        )

    return (
        F.when(path == "", "path-empty")
        .when(F.octet_length(path) > MAX_PATH_BYTES, "path-too-long")
        .when(path.rlike(r"[\x00-\x1f\x7f-\x9f]"), "path-control-character")
        .when(F.contains(path, F.lit("\\")), "path-backslash")
        .when(path.rlike(r"^(?:/|[A-Za-z]:)"), "path-absolute")
        .otherwise(F.get(F.filter(F.transform(segments, segment_reason), lambda r: r.isNotNull()), F.lit(0)))
    )


def ignore_reason(path: Column, extra_roots: list[str] | None = None, output_root: str = OUTPUT_ROOT) -> Column:
    """``struct<reason, rule>`` of the first rule that ignores the path; both null when tracked."""
    segments = F.split(path, "/")
    head = F.get(segments, F.lit(0))
    directories = F.slice(segments, F.lit(1), F.size(segments) - 1)
    name = last_part(path, "/")
    any_depth = F.get(
        F.filter(F.transform(directories, lambda s: _lookup(s, ANY_DEPTH_DIRECTORIES)), lambda r: r.isNotNull()),
        F.lit(0),
    )
    root = _lookup(head, ROOT_DIRECTORIES)
    by_extension = _lookup(F.lower(extension(path)), IGNORED_EXTENSIONS)

    def verdict(reason: Column | str, rule: str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(reason.alias("reason"), F.lit(rule).alias("rule"))

    nothing = F.struct(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("rule"))
    chain = F.when(head == output_root, verdict("generated_graph_data", "policy.graph-output-root"))
    if extra_roots:
        chain = chain.when(head.isin(*extra_roots), verdict("generated_graph_data", "policy.additional-root"))
    return (
        chain.when(root.isNotNull(), verdict(root, "policy.project-root-directory"))
        .when(any_depth.isNotNull(), verdict(any_depth, "policy.any-depth-directory"))
        .when(by_extension.isNotNull(), verdict(by_extension, "policy.extension"))
        .when(
            name.startswith("~$") | (name.startswith(".") & name.endswith(".swp")),
            verdict("editor_temporary_file", "policy.editor-temporary-name"),
        )
        .when(
            name.endswith(".tmp") | F.contains(name, F.lit(".tmp.")),
            verdict("editor_temporary_file", "policy.atomic-replace-scratch"),
        )
        .otherwise(nothing)
    )


def secret_match(path: Column) -> Column:
    """The directory, name or extension that marks a path as secret, or null."""
    segments = F.split(path, "/")
    directories = F.slice(segments, F.lit(1), F.size(segments) - 1)
    secret_dir = F.get(F.filter(directories, lambda s: F.lower(s).isin(*SECRET_DIRECTORIES)), F.lit(0))
    name = F.lower(last_part(path, "/"))
    ext = F.lower(extension(path))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)
    return (
        F.when(secret_dir.isNotNull(), secret_dir)
        .when(name.isin(*SECRET_NAMES), name)
        .when(ext.isin(*SECRET_EXTENSIONS), ext)
        .when(stem == ".env", F.lit(".env"))
    )


def within_root(root: Column | str, candidate: Column) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    root = F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    candidate = F.replace(candidate, F.lit("\\"), F.lit("/"))
    return (root != "") & ((candidate == root) | F.startswith(candidate, F.concat(root, F.lit("/"))))


def input_skip(path: Column, entry_kind: Column, target: Column, root: str, follow_symlinks: bool = True) -> Column:
    """``struct<skip, detail>`` for inputs that may not be parsed; both null when they may."""
    secret = secret_match(path)
    link = entry_kind == "symlink"
    skip = F.when(secret.isNotNull(), "secret").when(link & target.isNull(), "symlink_unresolved")
    if follow_symlinks:
        skip = skip.when(link & ~within_root(root, target), "symlink_escape")
    else:
        skip = skip.when(link, "symlink_disallowed")
    detail = F.when(secret.isNotNull(), secret).when(skip == "symlink_escape", target)
    return F.struct(skip.alias("skip"), detail.alias("detail"))


def language(path: Column) -> Column:
    return _lookup(F.lower(F.when(F.contains(path, F.lit(".")), last_part(path, "."))), LANGUAGE_OF_EXTENSION)


def unsupported_pattern(path: Column) -> Column:
    """Null for a supported language, else the coverage pattern that names the extension."""
    ext = F.lower(F.when(F.contains(path, F.lit(".")), last_part(path, ".")))
    return F.when(
        language(path).isNull(), F.concat(F.lit("unsupported-language:"), F.coalesce(ext, F.lit("<none>")))
    )


def config_kind(path: Column) -> Column:
    segments = F.split(path, "/")
    directories = F.slice(segments, F.lit(1), F.size(segments) - 1)
    name = F.lower(last_part(path, "/"))
    return (
        F.when(F.exists(directories, lambda s: F.lower(s) == "annotations"), "annotation")
        .when(name.isin(*SHARED_BUILD_FILES), "shared_build_config")
        .when(name.isin(*PACKAGE_LOCK_FILES), "package_lock")
        .when(name.rlike(r"\.(?:sln|slnx|slnf)$"), "solution_file")
        .when(name.rlike(r"\.(?:cs|fs|vb)proj$"), "project_manifest")
        .when(name.isin(*PACKAGE_MANIFEST_FILES), "package_manifest")
        .when(name.rlike(r"^(?:tsconfig\.json|jsconfig\.json|tsconfig\..*\.json)$"), "typescript_config")
        .when(name.isin(*ROUTE_FILES), "route_config")
    )


def config_scope(path: Column) -> Column:
    """none / project / solution: how far a change of this file invalidates."""
    kind = config_kind(path)
    return (
        F.when(ignore_reason(path)["reason"].isNotNull() | kind.isNull(), "none")
        .when(kind.isin(*SOLUTION_SCOPED), "solution")
        .otherwise("project")
    )


def fingerprint_changed(previous: Column, current: Column) -> Column:
    return ~previous.eqNullSafe(current)


def fold_relative(file: Column, specifier: Column) -> Column:
    """Join a relative specifier onto the directory of ``file``; null when it leaves the root."""
    segments = F.split(file, "/")
    start = F.slice(segments, F.lit(1), F.size(segments) - 1)
    nothing = F.lit(None).cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(stack.isNull(), nothing)
            .when(part.isin("", "."), stack)
            .when((part == "..") & (F.size(stack) == 0), nothing)
            .when(part == "..", F.slice(stack, F.lit(1), F.size(stack) - 1))
            .otherwise(F.concat(stack, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(specifier, "/"), start, step), "/")


def fold_target(target: Column, remainder: Column) -> Column:
    """Join an alias target root and the rest of a specifier; ``..`` stops at the root."""
    start = F.filter(F.split(target, "/"), lambda part: ~part.isin("", "."))

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), stack)
            .when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(remainder, "/"), start, step), "/")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
