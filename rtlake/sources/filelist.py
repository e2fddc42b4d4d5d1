"""Project configurations: filelists, JSON manifests, and where they are found."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Names under which a configuration is looked for, in order.
NAMES = (".rtlake.json", "rtlake.json", ".rtlake.f", "rtlake.f", "files.f")


@dataclass
class Project:
    files: list[str] = field(default_factory=list)
    defines: dict[str, str] = field(default_factory=dict)
    include_dirs: list[str] = field(default_factory=list)
    library_dirs: list[str] = field(default_factory=list)
    library_files: list[str] = field(default_factory=list)
    lib_extensions: list[str] = field(default_factory=list)
    preincludes: list[str] = field(default_factory=list)
    top: str = ""


def tokens(line: str) -> list[str]:
    """Words of a filelist line; quotes hold blanks, ``//`` and ``#`` begin comments."""
    return [a or b for a, b in re.findall(r'"([^"]*)"|((?:(?!//)[^\s"#])+)', re.sub(r"(^|\s)(//|#).*", r"\1", line))]


def parse_filelist(path: str, read: Callable[[str], str | None], project: Project | None = None, active: tuple[str, ...] = ()) -> Project:
    """A filelist with ``-f`` and ``-F`` nesting: ``-f`` paths are relative to the outermost list, ``-F`` paths to the list itself.

    ``read`` gives a path's text or None. A list within itself, an unreadable list and an unknown switch raise ValueError.
    """
    project = project if project is not None else Project()
    if path in active:
        raise ValueError(f"{path}: filelist cycle")
    text = read(path)
    if text is None:
        raise ValueError(f"{path}: can't be read")
    base = posixpath.dirname(path)
    at = lambda p: p if p.startswith("/") else posixpath.normpath(posixpath.join(base, p))
    for number, line in enumerate(text.split("\n"), 1):
        words = tokens(line)
        i = 0
        while i < len(words):
            w, value = words[i], words[i + 1] if i + 1 < len(words) else ""
            if w.startswith("+define+"):
                for part in w[len("+define+") :].split("+"):
                    name, _, v = part.partition("=")
                    project.defines[name] = v
            elif w.startswith("+incdir+"):
                project.include_dirs += [at(p) for p in w[len("+incdir+") :].split("+") if p]
            elif w.startswith("+libext+"):
                project.lib_extensions += [p for p in w[len("+libext+") :].split("+") if p]
            elif w in ("-f", "-F", "-y", "-v", "-top"):
                if not value:
                    raise ValueError(f"{path}:{number}: {w} needs a value")
                i += 1
                if w in ("-f", "-F"):
                    parse_filelist(at(value), read, project, (*active, path))
                elif w == "-top":
                    project.top = value
                else:
                    (project.library_dirs if w == "-y" else project.library_files).append(at(value))
            elif w in ("-sv", "-sverilog"):
                pass
            elif w[0] in "-+":
                raise ValueError(f"{path}:{number}: unsupported switch {w}")
            else:
                project.files.append(at(w))
            i += 1
    return project


def parse_manifest(path: str, text: str) -> Project:
    """A JSON manifest; every field is checked for its type."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from None
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: not an object")
    project, base = Project(), posixpath.dirname(path)
    at = lambda p: p if p.startswith("/") else posixpath.normpath(posixpath.join(base, p))
    for name, value in raw.items():
        if name in ("files", "include_dirs", "library_dirs", "library_files", "lib_extensions", "preincludes"):
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ValueError(f"{path}: {name} must be an array of strings")
            setattr(project, name, value if name == "lib_extensions" else [at(x) for x in value])
        elif name == "defines":
            if not isinstance(value, dict) or not all(isinstance(x, str) for x in value.values()):
                raise ValueError(f"{path}: defines must be an object of strings")
            project.defines = dict(value)
        elif name == "top":
            if not isinstance(value, str):
                raise ValueError(f"{path}: top must be a string")
            project.top = value
    return project


def discover(folder: str, exists: Callable[[str], bool]) -> str:
    """The nearest configuration at or above a folder; empty if there is none."""
    while True:
        for name in NAMES:
            if exists(p := posixpath.join(folder, name)):
                return p
        if folder in ("/", ""):
            return ""
        folder = posixpath.dirname(folder)


def library_file(name: str, dirs: list[str], extensions: list[str], exists: Callable[[str], bool]) -> str:
    """The file of a design unit in library folders: folders outside, extensions inside, first hit."""
    return next((p for d in dirs for e in extensions if exists(p := posixpath.join(d, name + e))), "")
