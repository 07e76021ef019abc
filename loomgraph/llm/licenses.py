"""The license of each code file and repository.

A logistic regression over word n-grams, trained on variants of templates, reads the statements in
comments, license files, manifests and a scanner's map; what it can't place with enough
probability, or what an exact check of name and version contradicts, counts as terms outside the
list. The statements are then reconciled along the directories of each repository.
"""

from __future__ import annotations

import functools
import itertools
import json
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_key
from ..operators.skew import split_lookup
from ..session import cut
from .linear import NgramClassifier

#: Terms that aren't on the list, as a statement.
UNLISTED = "?"
CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"
CODE_FILE = r"\.(c|cc|cpp|h|java|js|ts|ets|py)$"
LICENSE_FILE = r"^(?i:LICEN[SC]E|COPYING)(?![A-Za-z])"
MANIFESTS = ("package.json", "oh-package.json5", "pom.xml", "CMakeLists.txt")
#: Least probability of the class a name is given to.
ACCEPT = 0.4

_NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4"}
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*|\+")


@functools.lru_cache(maxsize=100_000)
def _words(text: str) -> tuple[str, ...]:
    out = []
    for w in _WORD.findall(re.sub(r"([a-z])v\.?(?=\d)", r"\1 v ", text.lower())):
        if w[0].isdigit():
            w = re.sub(r"(\.0)+$", "", w)
        out.append({"v": "version", "licence": "license", "licenced": "licensed"}.get(w, _NUMBER_WORDS.get(w, w)))
    return tuple(out)


def words(text: str) -> list[str]:
    """Lower-case words and numbers; ``v``, ``licence``, spelled numbers and ``.0`` in one form."""
    return list(_words(text))


def name_variants(spdx: str, title: str, former: str | None) -> list[str]:
    """The ways in which a license is named, made by rule from its row in the list."""
    out = [spdx, title, *([former] if former else [])]
    version = (re.findall(r"\d+(?:\.\d+)*", spdx) or [""])[0]
    short = re.sub(r"\.0$", "", version)
    head = spdx.split("-")[0]
    if (apart := re.sub(r"(?<=[a-z])(?=[A-Z])", " ", head)) != head:
        out += [f"{apart} {v}" for v in (version, f"v{short}", f"version {short}")]
    if m := re.match(r"(GNU (?:\w+ )*General Public License) v[\d.]+ (only|or later)", title):
        long = m[1]
        for v in dict.fromkeys((version, short)):
            if m[2] == "only":
                out += [f"{head}v{v} only", f"{head}v{v}", f"{long}, version {v} only", f"{long}, version {v}", f"GNU {head} version {v}, and no later version", f"version {v} (and only {v}) of the {long}", f"GNU {head} v{v} only"]
            else:
                out += [f"{head}v{v}+", f"{head} {v}+", f"GNU {head} v{v} or later", f"{long}, version {v} or any later version", f"{long}, either version {v} or (at your option) any later version", f"version {v} or later of the {long}", f"{head}v{v} or later"]
    elif head == "BSD":
        word = {v: k for k, v in _NUMBER_WORDS.items()}[version]
        nick = re.findall(r'"(\w+)"', title)
        out += [f"BSD {version}-Clause license", f"{version}-clause BSD license", f"BSD license with {word} clauses", f"{word}-clause BSD license", f"the BSD license, {version} clauses", *(f"{n} BSD License" for n in nick)]
    elif version:
        base = re.sub(r",? (?:Version )?\d+(?:\.\d+)*$", "", title)
        for v in dict.fromkeys((version, short)):
            out += [f"{base}, Version {v}", f"{base} {v}", f"{base} v{v}", f"{base}, v. {v}", f"{base} - v {v}", f"version {v} of the {base}", f"{head} {v}", f"{head} {v} license", f"{head} version {v}", f"{head} License, version {v}"]
    else:
        plain = re.sub(r"^The | License$", "", title)
        out += [f"{n} license" for n in (spdx, plain)] + [f"license known as {n}" for n in (spdx, plain)] + [plain]
    return list(dict.fromkeys(out))


# The sentences to learn from are put together by rule, after public guides on how to apply licenses;
# no wording is taken from the texts that are read. {n}: a name.
#: Tags and bare names.
TAGS = ("{n}", "SPDX-License-Identifier: {n}", "@license {n}", "License: {n}")
_THINGS = ("this library", "the code in this directory", "this module", "this component", "the software", "this product", "these sources", "the accompanying source", "this header", "each source in this package", "the package", "everything here", "all content of the file", "every line below", "the whole file", "this code", "this work", "our code")
_GRANTS = (
    "is free software under", "is licensed to you under", "is offered under", "is provided under", "is published under", "is covered by", "may be copied under", "can be reused under", "is shared under",
    "is placed under", "is open source under", "is governed by", "is subject to", "is available under", "is distributed under", "is released to the public under", "must only be used under", "falls under",
)
_VIA = ("the {n}", "the rules of the {n}", "the conditions of the {n}", "the {n} license", "{n}")
_TAILS = ("", ".", ", without warranty of any kind.", "; a copy ships with the sources.", ", provided this header is retained.", "; get a copy from its publisher.", ", at no charge.")
_OTHER_GRANTS = (
    "you can redistribute it and/or modify it under {v}{t}", "permission to copy, modify and distribute is granted under {v}{t}", "you may not use it except in compliance with {v}{t}", "we license {x} to you under {v}{t}", "the contributors offer {x} under {v}{t}", "terms: {v}{t}", "licensing terms for {x}: {v}{t}", "usage of {x} is permitted under {v}{t}", "copying is allowed if {v} is obeyed{t}",
    "use of {x} is governed by {v}{t}", "copying of {x} is governed by {v}{t}", "use and copying of {x} are bound by {v}{t}", "we put {x} under {v}{t}", "the owners have put {x} under {v}{t}", "the writers put {x} under {v}{t}", "copies may be passed on under {v}{t}", "changed versions may be shared when {v} is obeyed{t}",
    "some pieces of {x} are under {v}", "a portion of {x} comes under {v}", "the rest of {x} comes under {v}, and both bind you", "sections of {x} are under {v}", "and sections under {v}, all of which apply", "some portions are under {v}, others under {v}",
    "licensed under {v}{t}", "made public under {v}{t}", "under {v}{t}", "choose {v}{t}", "at your preference {v}{t}", "one portion is under {v}", "and the remaining portion under {v}, each of which binds you.",
)
_RULES = ("governs", "covers", "applies to", "holds for", "regulates", "is in force for")
_READERS = ("this helper", "the function", "a regression check", "our scanner", "this script", "the report", "the parser")
_LOOKS = ("checks whether a dependency is under {v}", "recognises {v}", "searches for texts of {v}", "prints which modules use {v}", "rewrites mentions of {v}", "counts projects that carry {v}", "downloads the wording of {v}", "matches a file against {v}", "decides if an import is compatible with {v}", "warns about components with {v}")
_DENIALS = (
    "{x} is not licensed under {v}{t}", "{x} isn't under {v}{t}", "{x} does not come under {v}{t}", "{v} does not apply to {x}", "{x} is not subject to {v}", "it was never released under {v}",
    "not {p} {v}", "{x} is not {p} {v}{t}", "never {p} {v}{t}", "isn't {p} {v}", "neither is {x} {p} {v}", "nothing here is {p} {v}", "in contrast to code under {v}, {x} is our own", "unlike work under {v}, {x} belongs to us", "compare with the sample of {v}", "tests the detection of {v}", "turns headers of {v} into short tags",
)
_PUT = ("licensed under", "released under", "bound by", "governed by", "distributed under", "offered under", "subject to", "published under", "regulated by", "held to")
_POINTS = ("see", "refer to", "consult", "read", "please look at", "the terms can be found in", "license details are given in", "for copying conditions see", "the wording of the license is in", "the license text resides in")
_PLACES = ("the LICENSE file", "LICENSE", "COPYING", "the file LICENSE in the root directory", "the file COPYING at the top level", "the NOTICE file", "the license file that ships with the sources", "LICENSE.txt for more information")
# sentences of license texts and headers that name no license
PLAIN = (
    "SEE LICENSE IN LICENSE", "copyright the contributors", "all rights are reserved by their owners", "redistributions in binary form must reproduce the above notice", "permission is hereby granted, free of charge, to any person obtaining a copy",
    "the names of its contributors must not be used to endorse products", "this software is provided by the holders as is and any implied warranties are disclaimed", "in no event shall the holders be liable for damages",
    "you may obtain a copy from its publisher", "you can get a copy at the address below", "a copy should have come with this program", "modified files must carry prominent notices", "you must retain the above notice and this list of conditions", "no warranty is given", "/usr/bin/env node", "utility code for the build", "generated by a tool, changes will be lost", "returns the first match or nothing", "one entry for each key",
    "anybody who gets a copy can use, modify and share it", "who shares a modified copy has to keep these conditions", "modifications must be marked", "the copyright notice must remain in each copy", "the authors are not liable and promise no fitness for any use",
)
# conditions as license texts state them, by subject, duty and object
_CONDITIONS = (
    (("the above notice", "this notice", "that list of conditions", "the copyright line", "every notice", "the notice"), ("shall remain in", "must stay in", "shall be included in", "has to be reproduced in", "must appear with", "stays with"), ("all copies", "each copy", "every substantial portion", "binary forms", "copies of the work", "any copy")),
    (("anyone", "whoever", "each person", "every recipient", "any person"), ("obtaining a copy can", "that gets a copy may", "who holds a copy is free to", "sharing a changed copy must", "distributing a changed copy has to", "who hands on copies must"), ("use it, modify it and share it", "keep the conditions as they are", "copy, merge and publish it", "retain the same conditions", "use and change it", "hand it to others")),
    (("alterations", "modifications", "altered files", "changed versions"), ("must be", "shall be", "need to be", "have to be"), ("marked", "stated clearly", "plainly marked as changed", "documented", "labelled as such")),
    (("the names of contributors", "names of the holders", "the author's name", "no names of authors"), ("must not be used to", "may never be used to", "cannot be used to", "shall not serve to"), ("endorse products", "promote derived works", "advertise other products", "recommend further work")),
    (("no holder", "no contributor", "none of the authors", "nobody"), ("is liable for", "is answerable for", "takes responsibility for", "answers for", "pays for"), ("damages", "any claim", "losses", "harm of any kind", "damage")),
    (("nothing is", "no fitness is", "no quality is", "no merchantability is"), ("promised", "warranted", "guaranteed", "assured"), ("by the authors", "about fitness for a purpose, nor does a holder pay for damage", "in any way, and nobody is liable", "about its quality")),
)
_OWNERS = ("", "shared ", "community ", "corporate ", "enterprise ", "source ", "private ", "evaluation ", "internal ", "commercial ", "proprietary ", "partner ", "public ", "open ", "software ", "house ", "code ", "use ")
_KINDS = ("license", "terms", "agreement", "contract", "conditions", "license 1.0", "license 2.0", "terms v3")


def _invented(rng: random.Random) -> str:
    """A name that no list has: made-up words and a kind of terms."""
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize()
    return " ".join([*(word() for _ in range(rng.randint(1, 3))), (rng.choice(_OWNERS) + rng.choice(_KINDS)).title()])


def stating_forms(rng: random.Random, many: int) -> list[str]:
    """Forms of sentences that put something under the terms ``{n}``."""
    out = []
    while len(out) < many:
        via, tail, thing = rng.choice(_VIA), rng.choice(_TAILS), rng.choice(_THINGS)
        kind = rng.random()
        form = f"{thing} {rng.choice(_GRANTS)} {via}{tail}" if kind < 0.45 else f"{via} {rng.choice(_RULES)} {thing}{tail}" if kind < 0.65 else rng.choice(_OTHER_GRANTS).format(v=via, t=tail, x=thing)
        out.append(form[:1].upper() + form[1:] if rng.random() < 0.8 else form)
    return out


def silent_forms(rng: random.Random, many: int) -> list[str]:
    """Forms of sentences that mention ``{n}`` and put nothing under its terms."""
    out = []
    while len(out) < many:
        via, thing = rng.choice(_VIA), rng.choice(_THINGS)
        form = f"{rng.choice(_READERS)} {rng.choice(_LOOKS).format(v=via)}" if rng.random() < 0.45 else rng.choice(_LOOKS).format(v=via) if rng.random() < 0.4 else rng.choice(_DENIALS).format(v=via, t=rng.choice(_TAILS[:2]), x=thing, p=rng.choice(_PUT))
        out.append(form[:1].upper() + form[1:] + rng.choice(("", ".")))
    return out


def pointers() -> list[str]:
    """Sentences that only say where the terms are."""
    told = [f"{s} {v}" for s in ("licensing terms", "the licensing conditions", "licensing information", "the license", "the copying terms", "the terms of use") for v in ("live in", "stand in", "are found in", "are in", "can be read in", "is in")]
    return [f"{p} {f}{e}" for p in [*_POINTS, *told] for f in _PLACES for e in ("", ".")]


def conditions() -> list[str]:
    """Sentences of license texts that state conditions and name no license."""
    return [f"{' '.join(parts)}." for group in _CONDITIONS for parts in itertools.product(*group)]


def _filler(rng: random.Random) -> str:
    """A line of a comment that is about something else."""
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    return rng.choice(("{} {} for {}", "{} after {}", "keep {} before {}", "{} then {}", "{} feeds {}", "{} the {} of each {}", "{} {}", "{} {} {} {}")).format(word(), word(), word(), word())


class LicenseReader:
    """Two regressions (does a sentence state terms; which) and the exact check behind them."""

    def __init__(self, listed: list[tuple[str, str, str | None]], seed: int = 7, per_name: int = 10):
        rng = random.Random(seed)
        variants = {spdx: name_variants(spdx, title, former) for spdx, title, former in sorted(listed)}
        self.spdx = {spdx.lower(): spdx for spdx in variants}
        invented = [_invented(rng) for _ in range(400)]
        stance, which = [], []

        def within(sentence: str) -> str:
            """Now and then with lines about something else around it."""
            before, after = rng.random() < 0.2, rng.random() < 0.3
            return " ".join([*[_filler(rng)] * before, sentence, *[_filler(rng)] * after])

        for spdx, names in [*variants.items(), (UNLISTED, invented)]:
            # licenses of few names get more sentences for each
            many = max(per_name, 160 // len(names)) if spdx != UNLISTED else 3
            for name in names:
                said = [*rng.choices(TAGS, k=2 if spdx == UNLISTED else 3), *stating_forms(rng, many)]
                which += [(within(form.format(n=name)), spdx) for form in said]
                stance += [(within(form.format(n=name)), "states") for form in said]
                stance += [(within(form.format(n=name)), "silent") for form in silent_forms(rng, many if spdx != UNLISTED else 2)]
        stance += [(within(form.format(n="").strip(" .")), "silent") for form in silent_forms(rng, 40)]
        stance += [(within(text), "silent") for text in [*PLAIN * 4, *pointers(), *conditions()]]
        stance += [(_filler(rng), "silent") for _ in range(400)]
        self.stance = NgramClassifier(words).fit(*zip(*stance, strict=True))
        self.which = NgramClassifier(words).fit(*zip(*which, strict=True))
        self.names = {spdx: self._identity(spdx, names) for spdx, names in variants.items()}
        self._cached_sentence = functools.lru_cache(maxsize=50_000)(self._sentence)
        self._cached_expression = functools.lru_cache(maxsize=50_000)(self._expression)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_cached")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._cached_sentence = functools.lru_cache(maxsize=50_000)(self._sentence)
        self._cached_expression = functools.lru_cache(maxsize=50_000)(self._expression)

    @staticmethod
    def _identity(spdx: str, names: list[str]) -> tuple[set[str], set[str], str]:
        """Words of which a name of the license must hold one, the numbers it may hold, its range."""
        common = set(words("GNU license version software public general permissive with known as of the and only or any later no either at your option clause clauses new simplified +"))
        keys = set(words(spdx)) | {w for n in names for w in words(n) if not w[0].isdigit()}
        keys = {w for w in keys if not w[0].isdigit()} - common
        if "lesser" not in keys and "gpl" in keys:
            keys.add("general")
        kind = "later" if spdx.endswith("-or-later") else "only" if spdx.endswith("-only") else ""
        return keys, {w for n in names for w in words(n) if w[0].isdigit()}, kind

    def _check(self, spdx: str, text: str) -> bool:
        """Whether name, version and range found in the text are those of the license."""
        found = set(words(text))
        keys, numbers, kind = self.names[spdx]
        if not found & keys:
            return False
        said = {w for w in found if w[0].isdigit()}
        if (numbers and not said & numbers and kind) or said - numbers:
            return False
        if kind:
            lesser = bool(found & {"lesser", "lgpl", "library"})
            later = "+" in found or bool(re.search(r"\b(?<!no )later\b", text.lower()))
            return lesser == spdx.startswith("LGPL") and not found & {"affero", "agpl"} and later == (kind == "later")
        return True

    def _name(self, text: str) -> str:
        """The license a name means, or UNLISTED."""
        if re.search(r"(?i)\bwith\b.*exception", text):
            return UNLISTED
        p = self.which.proba(text)
        best = self.which.classes[int(p.argmax())]
        if best == UNLISTED or p.max() < ACCEPT or not self._check(best, re.sub(r"\brevision \d+", "", text)):
            return UNLISTED
        return best

    def _operands(self, text: str) -> tuple[list[str], set[str]]:
        """The parts of a text that may each name a license, and what joins them."""
        hidden = re.sub(r"(?i)\b(and no|or any|or)\s+(\(at your option\)\s+)?(any\s+)?later(\s+versions?)?", lambda m: re.sub(r"\s+", "\x00", m[0]), text)
        hidden = re.sub(r"(?i)\(and only", "(and\x00only", hidden)
        parts = re.split(r"(?i)(?:^|[\s(])(and|or)(?=[\s)]|$)", hidden)
        return [p.replace("\x00", " ").strip(" ()") for p in parts[::2]], {p.upper() for p in parts[1::2]}

    def _joined(self, names: list[str], joins: set[str]) -> str:
        if UNLISTED in names or len(joins) > 1:
            return UNLISTED
        names = sorted(set(names))
        return f" {joins.pop()} ".join(names) if len(names) > 1 else names[0]

    def _expression(self, text: str) -> str | None:
        """What a license field or tag says, or None if it states nothing."""
        value = text.strip().strip("'\",;").strip()
        if not value or re.fullmatch(r"(?i)noassertion|none|null|licenseref-.*", value):
            return None
        parts, joins = self._operands(value)
        parts = [p for p in parts if p]
        if not parts:
            return None
        if re.search(r"(?i)\bsee\b|\bfile\b", value) and self._silent(f"License: {value}"):
            return None
        return self._joined([self._name(p) for p in parts], joins)

    def _silent(self, sentence: str) -> bool:
        return self.stance.proba(sentence)[self.stance.classes.index("silent")] > 0.5

    def _sentence(self, text: str) -> str | None:
        if self._silent(text):
            return None
        parts, joins = self._operands(text)
        if joins:
            found = [self._name(p) for p in parts]
            listed = [f for f in found if f != UNLISTED]
            if len(listed) > 1:
                # only what joins two names joins the statement
                at = [i for i, f in enumerate(found) if f != UNLISTED]
                between = re.findall(r"(?i)(?<![\w-])(and|or)(?![\w-])", text[text.find(parts[at[0]]) + len(parts[at[0]]) : text.rfind(parts[at[-1]])])
                return self._joined(listed, {between[0].upper()} if between else joins)
        return self._name(text)

    def expression(self, text: str | None) -> str | None:
        return None if text is None else self._cached_expression(text)

    def prose(self, text: str) -> set[str]:
        """Every statement of a comment or license file whose marks are gone."""
        out: set[str] = set()
        paragraph: list[str] = []
        lines = [*text.split("\n"), ""]

        def close() -> None:
            for sentence in re.split(r"(?<=[.!?])(?:\n(?!\s*\d)|\s+(?=[A-Z\"(]))", "\n".join(paragraph)):
                if re.search(r"\w", sentence) and (found := self._cached_sentence(" ".join(sentence.split()))):
                    out.add(found)
            paragraph.clear()

        i = 0
        while i < len(lines):
            line = lines[i].strip().strip("~=*#-").strip()
            i += 1
            if m := re.match(r"(?i)(?:spdx-licen[sc]e-identifier\s*:|@licen[sc]e\b\s*:?|licen[sc]e\s*:)\s*(.*)$", line):
                close()
                value = m[1]
                while i < len(lines) and lines[i].strip() and (not value.strip() or re.search(r"(?i)\b(and|or)$", value.strip()) or value.count("(") > value.count(")") or re.match(r"(?i)\s*(and|or)\s", lines[i])):
                    value = f"{value} {lines[i].strip()}"
                    i += 1
                if found := self.expression(value):
                    out.add(found)
            elif not line or re.match(r"(?i)(?:copyright\b|\(c\)|©)", line):
                close()
            else:
                paragraph.append(line)
        return out


_BLOCK = re.compile(r"/\*(.*?)\*/|<!--(.*?)-->|\"\"\"(.*?)\"\"\"", re.S)
_LINE = re.compile(r"[ \t]*(?://|#(?!include\b|define\b|if|endif|pragma|undef))(.*)")


def leading_comment(text: str) -> str:
    """The comment a file begins with, without its marks; empty if there is none.

    A byte-order mark, blank lines, a script's first line and an XML declaration may come before.
    Comments that follow each other with nothing but blanks in between are one.
    """
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    at, out = 0, []
    if m := re.match(r"\s*(?:#![^\n]*\n|<\?xml.*?\?>)", text, re.S):
        at = m.end()
    while True:
        at = re.compile(r"\s*").match(text, at).end()
        if m := _BLOCK.match(text, at):
            inner = next(g for g in m.groups() if g is not None)
            out += [line.strip().strip("*") for line in inner.lstrip("*!").split("\n")]
            out.append("")
            at = m.end()
        elif m := _LINE.match(text, text.rfind("\n", 0, at) + 1 if not text[text.rfind("\n", 0, at) + 1 : at].strip() else at):
            out.append(re.sub(r"^[/#!]*", "", m[1]))
            at = m.end()
        else:
            return "\n".join(out)


def manifest_fields(name: str, text: str) -> list[str]:
    """The values of the license field of a manifest; pointers to a file are no values."""
    if name == "package.json":
        try:
            data = json.loads(text.lstrip("\ufeff"))
        except (ValueError, RecursionError):
            return re.findall(r'"license"\s*:\s*"([^"]*)"', text)
        found = []
        for key in ("license", "licenses"):
            value = data.get(key) if isinstance(data, dict) else None
            for v in value if isinstance(value, list) else [value]:
                found.append(v.get("type") if isinstance(v, dict) else v)
        return [v for v in found if isinstance(v, str)]
    if name == "oh-package.json5":
        bare = re.sub(r"(?m)^\s*//.*$|/\*.*?\*/", "", text, flags=re.S) if "/*" in text else re.sub(r"(?m)^\s*//.*$", "", text)
        return [m[1] for m in re.findall(r"""(?:^|[{,\s])["']?licen[sc]e["']?\s*:\s*(["'])(.*?)\1""", bare)]
    if name == "pom.xml":
        return re.findall(r"<license>\s*(?:<(?!name)\w+>[^<]*</\w+>\s*)*<name>\s*([^<]*?)\s*</name>", re.sub(r"<!--.*?-->", "", text, flags=re.S))
    return []


def file_statements(reader: LicenseReader, kind: str, name: str, text: str | None) -> set[str]:
    """What one file says: ``kind`` is ``code``, ``license`` or ``manifest``."""
    if not text:
        return set()
    if kind == "license":
        plain = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        return reader.prose(plain)
    said = reader.prose(leading_comment(text)) if name != "package.json" else set()
    if kind == "manifest":
        said |= {v for field in manifest_fields(name, text) if (v := reader.expression(field))}
    return said


def train_reader(license_list: DataFrame) -> LicenseReader:
    """A reader for the licenses of a list of fixed size (read by the driver)."""
    rows = license_list.select("spdx", "title", "former_id").filter(F.col("spdx").isNotNull()).distinct().collect()
    return _trained(tuple(sorted((r.spdx, r.title or r.spdx, r.former_id or "") for r in rows)))


@functools.lru_cache(maxsize=4)
def _trained(listed: tuple[tuple[str, str, str], ...]) -> LicenseReader:
    """One training per list, however many queries ask for it."""
    return LicenseReader([(spdx, title, former or None) for spdx, title, former in listed])


def _kind(path: Column, name: Column) -> Column:
    return (
        F.when(path.rlike(CODE_FILE), "code")
        .when(name.isin(*MANIFESTS), "manifest")
        .when(name.rlike(LICENSE_FILE), "license")
    )


def read_files(files: DataFrame, reader: LicenseReader) -> DataFrame:
    """``graph_id, path, key, dir, kind, said``: each relevant file with its distinct statements."""
    name = F.regexp_extract(node_key("path"), r"([^/]*)$", 1)
    rows = files.select("graph_id", "path", name.alias("name"), "content").withColumn("kind", _kind(F.col("path"), F.col("name")))
    rows = rows.filter(F.col("kind").isNotNull())
    schema = "graph_id string, path string, kind string, said array<string>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [sorted(file_statements(reader, k, n, t)) for k, n, t in zip(*(b.column(i).to_pylist() for i in (4, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(said, pa.list_(pa.string()))], ["graph_id", "path", "kind", "said"])

    read = rows.select("graph_id", "path", "name", "content", "kind").mapInArrow(run, schema)
    return read.withColumn("key", node_key("path")).withColumn("dir", F.regexp_replace("key", "/[^/]*$", "")).distinct()


def scanner_statements(licenses: DataFrame, reader: LicenseReader) -> DataFrame:
    """``key, value``: the distinct statements of a scanner's map; values that state nothing are gone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [reader.expression(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.string())], ["key", "value"])

    rows = licenses.select(node_key("node_id").alias("key"), "spdx").filter(F.col("key").isNotNull() & F.col("spdx").isNotNull()).distinct()
    return rows.mapInArrow(run, "key string, value string").filter(F.col("value").isNotNull()).distinct()


def _agree() -> Column:
    """One value if all agree, else CONFLICT; for a group of statements ``value``."""
    return F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(CONFLICT).alias("verdict")


def resolve_licenses(files: DataFrame, licenses: DataFrame, registry: DataFrame, reader: LicenseReader, hot_share: float = 0.01) -> DataFrame:
    """``scope, item_id, license`` of each code file (``file``) and registered graph (``repo``).

    A file's own statements are those of its leading comment and of the scanner's map. A file
    without any has those of the license files and manifests of the nearest directory, from its own
    up to the top directory of the repository, that has any, within its graph. A repository has
    those of its top directory. The result is the license all statements agree on; ``CONFLICT`` if
    they differ; ``UNKNOWN`` if there are none, or if they name terms outside the list. Rescanned
    files and repeated map entries count once; null paths and graph ids are no items; a file of
    null graph inherits nothing; empty files state nothing. Extra columns don't matter.

    Directories are far fewer than files: the walk to the nearest directory is made once per
    directory, by joining each with its ancestors, and files look up their directory's result by a
    join that treats crowded directories apart.
    """
    place = lambda g, d: F.concat_ws("\x00", g, d)
    read = cut(read_files(files.filter(F.col("path").isNotNull()), reader))
    code = read.filter(F.col("kind") == "code")
    says = code.select("path", F.explode("said").alias("value"))
    mapped = code.select("path", "key").join(scanner_statements(licenses, reader), "key").select("path", "value")
    own = says.unionByName(mapped).groupBy("path").agg(_agree())
    told = code.select("graph_id", "path", "dir").join(own, "path", "left")
    silent = told.filter(F.col("verdict").isNull() & F.col("graph_id").isNotNull())
    by_dir = (
        read.filter((F.col("kind") != "code") & F.col("graph_id").isNotNull())
        .select("graph_id", "dir", F.explode("said").alias("value"))
        .groupBy("graph_id", "dir")
        .agg(_agree())
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    climbed = silent.select("graph_id", "dir").distinct().filter(F.size(parts) >= 2).select("graph_id", "dir", F.explode(above).alias("x")).select(place("graph_id", "dir").alias("place"), "x.n", place("graph_id", "x.up").alias("up"))
    nearest = (
        split_lookup(climbed, by_dir.select(place("graph_id", "dir").alias("up"), "verdict"), "up", hot_share, how="inner")
        .groupBy("place")
        .agg(F.max_by("verdict", "n").alias("inherited"))
    )
    inherits = split_lookup(silent.select("path", place("graph_id", "dir").alias("place")), nearest, "place", hot_share)
    found = told.filter(F.col("verdict").isNotNull()).select("path", F.col("verdict").alias("value")).unionByName(
        inherits.select("path", F.col("inherited").alias("value"))
    ).unionByName(told.filter(F.col("verdict").isNull() & F.col("graph_id").isNull()).select("path", F.lit(None).cast("string").alias("value")))
    shown = lambda c: F.when(F.col(c).isNull() | (F.col(c) == UNLISTED), UNKNOWN).otherwise(F.col(c)).alias("license")
    per_file = found.groupBy("path").agg(F.when(F.count("value") > 0, _agree()).alias("verdict")).select(F.lit("file").alias("scope"), F.col("path").alias("item_id"), shown("verdict"))
    tops = by_dir.filter(F.col("dir").rlike("^/[^/]+$")).select("graph_id", F.col("verdict").alias("value")).groupBy("graph_id").agg(_agree())
    repos = registry.select("graph_id").filter(F.col("graph_id").isNotNull()).distinct().join(tops, "graph_id", "left")
    return per_file.unionByName(repos.select(F.lit("repo").alias("scope"), F.col("graph_id").alias("item_id"), shown("verdict")))
