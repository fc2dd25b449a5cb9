"""Admission policy as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the formats they have.
FORMATS = {
    ".md": "markdown", ".markdown": "markdown", ".mdx": "markdown", ".txt": "text", ".text": "text", ".html": "html", ".htm": "html", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".ts": "code", ".tsx": "code", ".js": "code", ".jsx": "code", ".mjs": "code", ".cjs": "code", ".py": "code", ".go": "code", ".cs": "code", ".java": "code", ".rb": "code", ".rs": "code", ".sh": "code", ".sql": "code",
}
# Directories never entered.
IGNORED_DIRECTORIES = (
    ".bundle", ".cache", ".git", ".gradle", ".hg", ".idea", ".mypy_cache", ".next", ".nuxt", ".nyc_output", ".pytest_cache", ".svn", ".terraform", ".tox", ".venv", ".vs",
    "__pycache__", "bin", "build", "coverage", "dist", "node_modules", "obj", "out", "target", "venv", "vendor", "System Volume Information", "$RECYCLE.BIN",
)
# Files never read, by lower-case name.
IGNORED_FILES = (".ds_store", ".env", ".netrc", ".npmrc", ".pgpass", "credentials", "desktop.ini", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa", "package-lock.json", "thumbs.db")
# Names that suggest secrets, in any case.
SECRET_NAMES = (r"^\.env(\..+)?$", r"\.(pem|key|pfx|p12|jks|keystore|asc|gpg|ppk)$", r"(^|[._-])secrets?([._-]|$)", r"(^|[._-])credentials?([._-]|$)")
LONGEST_ID = 512
SNIFFED = 8_192
MOST_CONTROL = 0.05


def extension(identifier: Column) -> Column:
    """'.ext' of the last path segment in lower case; '' without one or if the name begins with its only dot."""
    return F.lower(F.regexp_extract(identifier, r"[^/](\.[^./]*)$", 1))


def format_of(ext: Column) -> Column:
    """The format of an extension; null if it isn't supported."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.try_element_at(known, F.lower(ext))


def ignored_directory(name: Column) -> Column:
    return name.isin("", ".", "..", *IGNORED_DIRECTORIES) | F.startswith(name, F.lit("."))


def ignored_file(name: Column) -> Column:
    secret = F.lit(False)
    for pattern in SECRET_NAMES:
        secret = secret | F.rlike(name, F.lit(f"(?i){pattern}"))
    return name.isin("", ".", "..") | F.lower(name).isin(*IGNORED_FILES) | F.startswith(name, F.lit(".")) | secret


def ignored(identifier: Column) -> Column:
    """Whether any segment keeps a document out; the last is a file, the others are directories."""
    parts = F.split(identifier, "/")
    return ignored_file(F.element_at(parts, -1)) | F.exists(F.slice(parts, 1, F.size(parts) - 1), ignored_directory)


def normalized(path: Column) -> Column:
    """A corpus-relative identifier; null for an unsafe path (absolute, climbing, empty segments, control characters, too long)."""
    slashed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    bad = (slashed == "") | (F.length(slashed) > LONGEST_ID) | F.rlike(slashed, F.lit(r"[\x00-\x1f\x7f-\x9f]")) | F.rlike(slashed, F.lit(r"^(/|[a-zA-Z]:/)"))
    return F.when(~(bad | F.rlike(slashed, F.lit(r"(^|/)\.{0,2}(/|$)"))), slashed)


def looks_binary(text: Column) -> Column:
    """NUL, or more than a twentieth control or replacement characters, among the first 8,192 characters."""
    head = F.substring(text, 1, SNIFFED)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F\uFFFD]", ""))
    return F.contains(head, F.lit("\0")) | (F.coalesce(odd / F.nullif(F.length(head), F.lit(0)), F.lit(0.0)) > MOST_CONTROL)
