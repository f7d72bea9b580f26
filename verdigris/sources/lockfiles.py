"""Lock files and env files as table functions.

A text is read line by line by an indentation stack: each line becomes a path of the
keys above it and what stands on it, and the formats pick from those. JSON locks are
parsed as JSON. The functions see one file at a time; Spark deals the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Folders whose lock files belong to somebody else.
VENDORED = ("node_modules", "vendor", "target", "venv", "dist", "build")
Entry = tuple[str, str]


def outline(text: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(path, line, indent) of each line that isn't blank: path has the lines above it with less indentation, outermost first."""
    above: list[tuple[int, str]] = []
    for raw in text.splitlines():
        line = raw.strip()
        if line:
            indent = len(raw) - len(raw.lstrip())
            while above and above[-1][0] >= indent:
                above.pop()
            yield tuple(x for _, x in above), line, indent
            above.append((indent, line))


def _parsed(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _objects(found: object) -> list[tuple[str, dict]]:
    return [(k, v) for k, v in found.items() if isinstance(v, dict)] if isinstance(found, dict) else []


def npm_lock(text: str) -> Iterator[Entry]:
    """Of the newer form what is installed under node_modules, without links and workspaces; of the older one its dependencies."""
    lock = _parsed(text)
    for place, about in _objects(lock.get("packages")):
        folder, found, name = place.rpartition("node_modules/")
        if found and not about.get("link"):
            yield name, about.get("version")
    for name, about in _objects(lock.get("dependencies")):
        yield name, about.get("version")


def composer_lock(text: str) -> Iterator[Entry]:
    lock = _parsed(text)
    for section in ("packages", "packages-dev"):
        for about in lock.get(section) or []:
            if isinstance(about, dict):
                yield about.get("name"), str(about.get("version") or "").lstrip("v")


def toml_lock(text: str) -> Iterator[Entry]:
    """name and version of each [[package]] table, from its own keys and not those of tables inside it."""
    own: dict[str, str] | None = None
    for raw in [*text.splitlines(), "[[package]]"]:
        line = raw.strip()
        if line.startswith("["):
            if line == "[[package]]" or not line.startswith("[package."):
                if own:
                    yield own.get("name", ""), own.get("version", "")
                own = {} if line == "[[package]]" else None
            elif own is not None:  # a table inside: what follows isn't the package's own
                yield own.get("name", ""), own.get("version", "")
                own = None
        elif own is not None and (pair := re.fullmatch(r'(name|version)\s*=\s*"([^"]+)".*', line)):
            own.setdefault(pair[1], pair[2])


def yarn_lock(text: str) -> Iterator[Entry]:
    """Blocks headed by wanted ranges (name@range, ...), with the version that they got."""
    for path, line, _ in outline(text):
        if len(path) == 1 and (version := re.fullmatch(r'version:?\s+"?([^"]+)"?', line)):
            name = re.match(r'"?(@?[^@"]+)@', path[0])
            if name and not path[0].startswith("#"):
                yield name[1], version[1]


def pnpm_lock(text: str) -> Iterator[Entry]:
    """Keys of the section packages: name@version, with or without a slash, quotes and peers in brackets."""
    for path, line, indent in outline(text):
        key = re.fullmatch(r"'?/?(@?[^@\s]+)@([^():\s']+)(\(.*\))?'?:.*", line)
        if key and indent == 2 and (line.startswith("/") or path[:1] == ("packages:",)):
            yield key[1], key[2]


def gem_lock(text: str) -> Iterator[Entry]:
    """The entries right below specs:, not what they need in turn."""
    for path, line, indent in outline(text):
        if indent == 4 and path[-1:] == ("specs:",) and (gem := re.fullmatch(r"([A-Za-z0-9_.\-]+)\s+\(([^)]+)\)", line)):
            yield gem[1], gem[2]


def pip_pins(text: str) -> Iterator[Entry]:
    for line in text.splitlines():
        if pin := re.match(r"\s*([A-Za-z0-9_.\-]+)\s*==\s*([A-Za-z0-9_.\-+]+)", line):
            yield pin[1], pin[2]


def go_requires(text: str) -> Iterator[Entry]:
    """Modules of require, alone or in brackets; other directives name none that is used."""
    inside = ""
    for raw in text.splitlines():
        line = raw.strip()
        if opened := re.match(r"(\w+)\s*\($", line):
            inside = opened[1]
        elif line == ")":
            inside = ""
        else:
            words = line.split()
            at = 0 if inside == "require" else 1 if not inside and words[:1] == ["require"] else None
            if at is not None and len(words) >= at + 2 and re.match(r"v[0-9]", words[at + 1]):
                yield words[at], words[at + 1]


#: File name -> (ecosystem, reader).
FORMATS = {
    "package-lock.json": ("npm", npm_lock),
    "yarn.lock": ("npm", yarn_lock),
    "pnpm-lock.yaml": ("npm", pnpm_lock),
    "poetry.lock": ("pypi", toml_lock),
    "requirements.txt": ("pypi", pip_pins),
    "Cargo.lock": ("cargo", toml_lock),
    "go.mod": ("go", go_requires),
    "Gemfile.lock": ("rubygems", gem_lock),
    "composer.lock": ("packagist", composer_lock),
}


@udtf(returnType="name string, version string, ecosystem string")
class LockEntries:
    """(name, version, ecosystem) of a lock file; nothing of other files and of vendored ones."""

    def eval(self, file: str, text: str) -> Iterator[tuple[str, str, str]]:
        *folders, name = (file or "").split("/")
        if name in FORMATS and text and not any(f in VENDORED or f.startswith(".") and f != "." for f in folders):
            ecosystem, read = FORMATS[name]
            for package, version in read(text):
                if isinstance(package, str) and isinstance(version, str) and package and version:
                    yield package, version, ecosystem


@udtf(returnType="line_no int, name string, value string")
class EnvEntries:
    """(line_no, name, value) of an env file: NAME=value lines, with export or not, a value without the quotes around it."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, line in enumerate(re.split("\r?\n", text or ""), 1):
            if found := re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(\S|\S.*\S)\s*", line):
                name, value = found.groups()
                yield i, name, value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def lockfile_inventory(files: DataFrame) -> DataFrame:
    """(repo, name, version, ecosystem, source) from lock files (repo, file, text); source is the first file of the repository that has the entry.

    file may be a path; what lies in vendored or hidden folders is passed over.
    Entries without a name or version and files that can't be read give nothing.
    """
    found = files.select("repo", "file", "text").lateralJoin(LockEntries(F.col("file").outer(), F.col("text").outer()))
    return found.groupBy("repo", "name", "version", "ecosystem").agg(F.min("file").alias("source")).select("repo", "name", "version", "ecosystem", "source")


def env_entries(files: DataFrame) -> DataFrame:
    """(repo, file, line_no, name, value) from env files (repo, file, text)."""
    found = files.select("repo", "file", "text").lateralJoin(EnvEntries(F.col("text").outer()))
    return found.select("repo", "file", "line_no", "name", "value")
