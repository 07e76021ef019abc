"""Build files as facts: targets, modules and dependencies, one pass over the files' texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_key


def _facts(files: DataFrame, names: tuple[str, ...], parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Facts of the distinct texts of files with these names; texts that can't be read give none."""
    columns = ["path", *[c.split()[0] for c in schema.split(", ")]]
    base = F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    rows = files.filter(base.isin(*names) & F.col("content").isNotNull()).select("path", "content").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(path, *row) for row in parse(text)]
                except (ValueError, RecursionError, ElementTree.ParseError, AttributeError):
                    continue
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, f"path string, {schema}")


def _npm(text: str) -> Iterator[tuple]:
    data = json.loads(text.lstrip("\ufeff"))
    spaces = data.get("workspaces") or []
    spaces = spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    for scope, field in (("runtime", "dependencies"), ("dev", "devDependencies"), ("peer", "peerDependencies"), ("optional", "optionalDependencies")):
        deps = data.get(field)
        for name, spec in deps.items() if isinstance(deps, dict) else ():
            yield data.get("name"), data.get("version"), scope, name, spec if isinstance(spec, str) else json.dumps(spec)
    for pattern in spaces if isinstance(spaces, list) else ():
        yield data.get("name"), data.get("version"), "workspace", str(pattern), ""


def npm_dependencies(files: DataFrame) -> DataFrame:
    """``path, package, version, scope, name, spec`` of package.json; workspace patterns have scope ``workspace``."""
    return _facts(files, ("package.json",), _npm, "package string, version string, scope string, name string, spec string")


def _maven(text: str) -> Iterator[tuple]:
    root = ElementTree.fromstring(text.lstrip("\ufeff").encode("utf-8"))
    bare = lambda tag: tag.rsplit("}", 1)[-1]
    child = lambda node, name: next((c for c in node if bare(c.tag) == name), None)
    text_of = lambda node, name: (c.text or "").strip() or None if node is not None and (c := child(node, name)) is not None else None
    parent = child(root, "parent")
    gav = [text_of(root, n) or text_of(parent, n) for n in ("groupId", "artifactId", "version")]
    gav[1] = text_of(root, "artifactId")
    yield (*gav, text_of(root, "packaging") or "jar", "module", None, None)
    for m in child(root, "modules") if child(root, "modules") is not None else ():
        yield (*gav, None, "contains", (m.text or "").strip(), None)
    for dep in child(root, "dependencies") if child(root, "dependencies") is not None else ():
        if text_of(dep, "scope") != "test":
            yield (*gav, None, "depends_on", f"{text_of(dep, 'groupId')}:{text_of(dep, 'artifactId')}", text_of(dep, "version"))


def maven_modules(files: DataFrame) -> DataFrame:
    """``path, group_id, artifact_id, version, packaging, fact, target, target_version`` of pom.xml.

    Group and version come from the parent where the project names none; dependencies of tests are left out.
    """
    return _facts(files, ("pom.xml",), _maven, "group_id string, artifact_id string, version string, packaging string, fact string, target string, target_version string")


_JSON5 = re.compile(r"(?P<skip>//[^\n]*|/\*.*?\*/)|(?P<double>\"(?:\\.|[^\"\\])*\")|'(?P<single>(?:\\.|[^'\\])*)'|(?P<name>[A-Za-z_$][\w$]*)(?=\s*:)|(?P<last>,)(?=\s*(?:(?://[^\n]*\n|/\*.*?\*/)\s*)*[}\]])|(?P<other>[^\"'/,A-Za-z_$]+|.)", re.S)


def strict_json(text: str) -> str:
    """JSON5 as JSON: comments and trailing commas gone, names and single-quoted strings in double quotes."""
    out: list[str] = []
    for m in _JSON5.finditer(text.lstrip("\ufeff")):
        if m["single"] is not None:
            out.append(json.dumps(m["single"].replace("\\'", "'")))
        elif m["name"]:
            out.append(json.dumps(m["name"]))
        else:
            out.append(m["double"] or m["other"] or "")
    return "".join(out)


def _hvigor(text: str) -> Iterator[tuple]:
    data = json.loads(strict_json(text))
    name, version = data.get("name"), data.get("version")
    yield name, version, "module", None, None
    for fact, field in (("depends_on", "dependencies"), ("dev_depends_on", "devDependencies")):
        deps = data.get(field)
        for dep, spec in deps.items() if isinstance(deps, dict) else ():
            local = isinstance(spec, str) and spec.startswith("file:")
            yield name, version, "local" if local else "native" if isinstance(spec, str) and spec.endswith(".so") else fact, dep, str(spec)


def hvigor_packages(files: DataFrame) -> DataFrame:
    """``path, name, version, fact, target, spec`` of oh-package.json5."""
    return _facts(files, ("oh-package.json5",), _hvigor, "name string, version string, fact string, target string, spec string")


def _lock(text: str) -> Iterator[tuple]:
    data = json.loads(strict_json(text))
    version = int(str(data.get("lockfileVersion") or 1).split(".")[0])
    entries = data.get("packages" if version >= 3 else "dependencies") or {}
    for key, entry in entries.items() if isinstance(entries, dict) else ():
        if not isinstance(entry, dict) or entry.get("registryType") == "local" or str(entry.get("version", "")).startswith("file:"):
            continue
        at = key.rfind("@")
        name = entry.get("name") or (key[:at] if at > 0 else key)
        yield name, str(entry.get("version") or (key[at + 1 :] if at > 0 else "")), version


def locked_packages(files: DataFrame) -> DataFrame:
    """``path, name, version, lock_version`` of oh-package-lock.json5, of both layouts; local packages are left out."""
    return _facts(files, ("oh-package-lock.json5",), _lock, "name string, version string, lock_version int")


_COMMAND = re.compile(r"([A-Za-z_]\w*)\s*\(((?:[^()\"\[]|\"(?:\\.|[^\"\\])*\"|\[=*\[.*?\]=*\]|\[|\((?:[^()]|\([^()]*\))*\))*)\)", re.S)
_ARGUMENT = re.compile(r"\[(=*)\[(.*?)\]\1\]|\"((?:\\.|[^\"\\])*)\"|([^\s()\"]+)", re.S)
_SCOPES = {"PUBLIC", "PRIVATE", "INTERFACE", "LINK_PUBLIC", "LINK_PRIVATE", "BEFORE", "AFTER", "SYSTEM", "REQUIRED", "COMPONENTS", "QUIET", "EXACT"}
_KINDS = {"SHARED": "shared_library", "STATIC": "static_library", "MODULE": "module", "INTERFACE": "target", "OBJECT": "target"}


def cmake_commands(text: str) -> Iterator[tuple[str, list[str]]]:
    """Commands in order with their arguments: bracketed, quoted and bare ones; comments left out."""
    text = re.sub(r"#\[(=*)\[.*?\]\1\]", "", text, flags=re.S)
    text = re.sub(r"(?m)^((?:[^\"#\n]|\"[^\"\n]*\")*)#[^\n]*", r"\1", text)
    for m in _COMMAND.finditer(text):
        yield m[1].lower(), [next(g for g in (a[2], a[3], a[4]) if g is not None) for a in _ARGUMENT.finditer(m[2])]


def expand(value: str, variables: dict[str, list[str]], deep: int = 10) -> list[str]:
    """A value with ``${NAME}`` replaced, again and again up to ``deep`` times; a lone variable gives its list."""
    for _ in range(deep):
        m = re.fullmatch(r"\$\{(\w+)\}", value)
        if m:
            found = variables.get(m[1], [])
            return [x for v in found for x in expand(v, variables, deep - 1)] if deep > 1 else found
        new = re.sub(r"\$\{(\w+)\}", lambda m: ";".join(variables.get(m[1], [])), value)
        if new == value:
            break
        value = new
    return [value] if value else []


def _cmake(text: str) -> Iterator[tuple]:
    variables: dict[str, list[str]] = {}
    for command, raw in cmake_commands(text):
        args = [x for a in raw for x in expand(a, variables)]
        if not args:
            continue
        if command == "set":
            variables[args[0]] = [a for a in args[1:] if a not in ("CACHE", "PARENT_SCOPE")]
        elif command == "list" and args[0].upper() == "APPEND" and len(args) > 1:
            variables.setdefault(args[1], []).extend(args[2:])
        elif command == "project":
            variables["PROJECT_NAME"] = [args[0]]
            yield "project", args[0], None, None
        elif command in ("add_library", "add_executable"):
            rest = args[1:]
            if "ALIAS" in rest:
                yield "alias_of", args[0], "target", rest[rest.index("ALIAS") + 1] if len(rest) > rest.index("ALIAS") + 1 else None
                continue
            kind = "executable" if command == "add_executable" else next((_KINDS[a] for a in rest if a in _KINDS), "static_library")
            yield "target", args[0], kind, None
            for source in rest:
                if source not in _KINDS and source not in ("EXCLUDE_FROM_ALL", "WIN32", "MACOSX_BUNDLE", "IMPORTED", "GLOBAL") and "$<" not in source:
                    yield "sources", args[0], kind, source
        elif command in ("target_link_libraries", "target_include_directories", "target_sources"):
            fact = {"target_link_libraries": "link_libraries", "target_include_directories": "include_dirs", "target_sources": "sources"}[command]
            for item in args[1:]:
                if item not in _SCOPES and "$<" not in item and len(item) > 1:
                    yield fact, args[0], link_class(item) if fact == "link_libraries" else None, item
        elif command in ("find_package", "fetchcontent_declare", "add_subdirectory"):
            fact = {"find_package": "external_library", "fetchcontent_declare": "external_library", "add_subdirectory": "subdirectory"}[command]
            version = next((a for a in args[1:] if re.fullmatch(r"\d+(\.\d+)*", a)), None)
            yield fact, args[0], None, version


def link_class(item: str) -> str:
    """What a linked item is: an id, an imported target, an open variable, a library file or a local target."""
    if item.startswith("//"):
        return "id"
    if "::" in item:
        return "imported"
    if "${" in item:
        return "variable"
    return "file" if item.endswith((".so", ".lib", ".dll", ".a")) else "local"


def cmake_targets(files: DataFrame) -> DataFrame:
    """``path, fact, subject, kind, object`` of CMakeLists.txt, variables of the file replaced.

    Facts: project, target, alias_of, sources, link_libraries, include_dirs, external_library, subdirectory.
    """
    return _facts(files, ("CMakeLists.txt",), _cmake, "fact string, subject string, kind string, object string")


def config_kind(path: Column | str) -> Column:
    """What a build file of the JSON5 kind is: build_profile, module, package, lock or tool; null for all others."""
    name = F.substring_index(node_key(path), "/", -1)
    return (
        F.when(name == "build-profile.json5", "build_profile").when(name.isin("module.json5", "module.json"), "module")
        .when(name == "oh-package.json5", "package").when(name == "oh-package-lock.json5", "lock").when(name == "hvigor-config.json5", "tool")
    )


def _profile(text: str) -> Iterator[tuple]:
    data = json.loads(strict_json(text))
    for m in data.get("modules") or [] if isinstance(data, dict) else []:
        if isinstance(m, dict) and isinstance(m.get("name"), str):
            option = m.get("buildOption") if isinstance(m.get("buildOption"), dict) else {}
            native = option.get("externalNativeOptions") if isinstance(option.get("externalNativeOptions"), dict) else {}
            yield m["name"], str(m.get("srcPath") or m["name"]), native.get("path") if isinstance(native.get("path"), str) else None


def build_profiles(files: DataFrame) -> DataFrame:
    """``path, name, src_path, native_path`` of the modules that build-profile.json5 files list."""
    return _facts(files, ("build-profile.json5",), _profile, "name string, src_path string, native_path string")


def _module(text: str) -> Iterator[tuple]:
    data = json.loads(strict_json(text))
    m = data.get("module") if isinstance(data, dict) else None
    if isinstance(m, dict):
        yield m.get("name") if isinstance(m.get("name"), str) else None, m.get("type") if isinstance(m.get("type"), str) else None, m.get("srcEntry") if isinstance(m.get("srcEntry"), str) else None


def module_configs(files: DataFrame) -> DataFrame:
    """``path, name, kind, entry`` of module.json5 and module.json files."""
    return _facts(files, ("module.json5", "module.json"), _module, "name string, kind string, entry string")


def _globs(text: str) -> Iterator[tuple]:
    for command, arguments in cmake_commands(text):
        if command == "file" and len(arguments) > 2 and arguments[0].upper() in ("GLOB", "GLOB_RECURSE"):
            skip = 0
            for i, pattern in enumerate(arguments[2:], 2):
                if skip or pattern.upper() in ("CONFIGURE_DEPENDS", "LIST_DIRECTORIES", "RELATIVE"):
                    skip = 0 if skip else int(pattern.upper() in ("LIST_DIRECTORIES", "RELATIVE"))
                    continue
                yield arguments[1], re.sub(r"^\$\{CMAKE(_CURRENT)?_(SOURCE|LIST)_DIR\}/", "", pattern), arguments[0].upper() == "GLOB_RECURSE"


def cmake_globs(files: DataFrame) -> DataFrame:
    """``path, variable, pattern, deep`` of the globs in CMakeLists.txt files; patterns count from the file's folder."""
    return _facts(files, ("CMakeLists.txt",), _globs, "variable string, pattern string, deep boolean")
