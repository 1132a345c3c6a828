"""Parsers of logs, for ranges.scan and ranges.ends: each composes over the ranges of a file, so a log of any length is read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.text import NUMBER


def number(text: str) -> float | None:
    """A word as a number, or None."""
    try:
        return float(text) if "_" not in text else None
    except ValueError:
        return None


class Counted:
    """Series of numbers: each pattern's matches, numbered from 0 over the whole file. Lines that match `barred` don't count for it."""

    ddl, after = "series string, place long, value double", 0

    def __init__(self, patterns: dict[str, str], hints: dict[str, str], barred: dict[str, str] | None = None, every: bool = True):
        """hints: a text that a line must hold to be looked at; every: all matches of a line, else the first."""
        self.patterns = {k: re.compile(p) for k, p in patterns.items()}
        self.hints, self.every = hints, every
        self.barred = {k: re.compile(p) for k, p in (barred or {}).items()}

    def start(self) -> dict:
        return dict.fromkeys(self.patterns, 0)

    def found(self, name: str, lines: list[str]) -> Iterator[str]:
        hint, pattern, barred = self.hints[name], self.patterns[name], self.barred.get(name)
        for line in lines:
            if hint in line and not (barred and barred.search(line)):
                if self.every:
                    yield from pattern.findall(line)
                elif match := pattern.search(line):
                    yield match[1]

    def summarise(self, lines: list[str], more: list[str]) -> dict:
        return {name: sum(1 for _ in self.found(name, lines)) for name in self.patterns}

    def step(self, state: dict, summary: dict) -> dict:
        return {k: v + summary[k] for k, v in state.items()}

    def rows(self, state: dict, lines: list[str], more: list[str], last: dict) -> Iterator[dict]:
        for name in self.patterns:
            for place, value in enumerate(self.found(name, lines), state[name]):
                yield {"series": name, "place": place, "value": number(value)}


class BestWay(Counted):
    """Of several patterns, best first, the first one that occurs anywhere in the file."""

    ddl = "place long, value double"

    def rows(self, state: dict, lines: list[str], more: list[str], last: dict) -> Iterator[dict]:
        best = next((name for name in self.patterns if last[name]), None)
        if best:
            for place, value in enumerate(self.found(best, lines), state[best]):
                yield {"place": place, "value": number(value)}


class Marked:
    """Whether any line matches a pattern."""

    ddl, after = "found boolean", 0

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def start(self) -> dict:
        return {"found": False}

    def summarise(self, lines: list[str], more: list[str]) -> bool:
        return any(map(self.pattern.search, lines))

    def step(self, state: dict, summary: bool) -> dict:
        return {"found": state["found"] or summary}


SIX = re.compile(rf"\s*(?:[-\d.]+\s+){{5}}[-\d.]+\s*")
DASHES = re.compile(r"\s*-+")


class LastPoint:
    """The last volume, energy and pressure, and the largest force of the last block of forces, which may cross ranges."""

    ddl, after = "volume double, energy double, pressure double, max_force double", 1
    patterns = {"volume": re.compile(rf"volume of cell\s*:\s*({NUMBER})"), "energy": re.compile(rf"free\s+energy\s+TOTEN\s*=\s*({NUMBER})"), "pressure": re.compile(rf"external pressure\s*=\s*({NUMBER})")}

    def start(self) -> dict:
        return {"volume": None, "energy": None, "pressure": None, "max_force": None, "open": 0}

    @staticmethod
    def block(lines: list[str], at: int) -> tuple[float | None, int]:
        """The largest force of the rows from a line on, and whether they go on beyond the range."""
        most = None
        for line in lines[at:]:
            if SIX.fullmatch(line):
                v = [number(x) for x in line.split()]
                if None not in v:
                    most = max(most or 0.0, sum(x * x for x in v[3:]) ** 0.5)
            elif line.strip():
                return most, 0
        return most, 1

    def summarise(self, lines: list[str], more: list[str]) -> dict:
        out: dict = {}
        for name, pattern in self.patterns.items():
            hint = {"volume": "volume of cell", "energy": "TOTEN", "pressure": "external pressure"}[name]
            for line in reversed(lines):
                if hint in line and (found := pattern.findall(line)):
                    out[name] = number(found[-1])
                    break
        following = [*lines[1:], *more[:1]]
        heads = [i for i, (a, b) in enumerate(zip(lines, following, strict=False)) if "TOTAL-FORCE" in a and DASHES.fullmatch(b)]
        if heads:
            at = heads[-1] + 2
            out["block"] = self.block(lines, at) if at <= len(lines) else (None, 2)
        elif lines:
            out["goes_on"] = [self.block(lines, 0), self.block(lines, 1)]  # if rows are going on, or dashes stand first
        return out

    def step(self, state: dict, summary: dict) -> dict:
        state = state | {k: summary[k] for k in self.patterns if k in summary}
        if "block" in summary:
            return state | {"max_force": summary["block"][0], "open": summary["block"][1]}
        if state["open"] and "goes_on" in summary:
            most, still = summary["goes_on"][state["open"] - 1]
            known = [x for x in (state["max_force"], most) if x is not None]
            state |= {"max_force": max(known) if known else None, "open": still}
        return state


class IonicSteps:
    """Electronic iterations and ionic lines, with the number of the step that they belong to."""

    ddl, after = "ionic_step long, iterations int, has_ionic_line boolean, temperature double, energy double", 0
    electronic = re.compile(r"\s*(?:DAV|RMM|CG|EDIA|SDA)\s*:\s*(\d+)")
    ionic = re.compile(r"\s*\d+\s+(?:T=|F=)")
    values = {k: re.compile(rf"(?:^|\s){k}=\s*({NUMBER})") for k in ("T", "E0", "E")}

    def start(self) -> int:
        return 0

    def summarise(self, lines: list[str], more: list[str]) -> int:
        return sum(1 for x in lines if self.ionic.match(x))

    def step(self, state: int, summary: int) -> int:
        return state + summary

    def rows(self, state: int, lines: list[str], more: list[str], last: int) -> Iterator[dict]:
        for line in lines:
            if self.ionic.match(line):
                v = {k: number(m[1]) if (m := p.search(line)) else None for k, p in self.values.items()}
                yield {"ionic_step": state, "iterations": None, "has_ionic_line": True, "temperature": v["T"], "energy": v["E"] if v["E0"] is None else v["E0"]}
                state += 1
            elif m := self.electronic.match(line):
                yield {"ionic_step": state, "iterations": int(m[1]), "has_ionic_line": False, "temperature": None, "energy": None}


class ThermoBlocks:
    """Blocks of numbers below a header that names them; a blank, short or non-numeric line closes a block.

    The lines before a range's first header belong to a block of an earlier range, whose width isn't known there: the summary tells for
    each width how many of them are good, by the places where a line has fewer words than all before it.
    """

    ddl, after = "block int, row long, step long, temperature double, volume double, energy double, pressure double", 0
    head = re.compile(r"(?i)step\s.*\btemp\b")
    columns = {"step": (["step"], 1), "temperature": (["temp"], 2), "volume": (["volume", "vol"], 4), "energy": (["toteng", "etotal"], 5), "pressure": (["press"], None)}

    def start(self) -> dict:
        return {"block": 0, "names": None, "row": 0, "open": False}

    @staticmethod
    def numbers(line: str) -> list[float] | None:
        v = [number(x) for x in line.split()]
        return v if v and None not in v else None

    def good(self, lines: list[str], width: int) -> int:
        for i, line in enumerate(lines):
            v = self.numbers(line)
            if v is None or len(v) < width:
                return i
        return len(lines)

    def summarise(self, lines: list[str], more: list[str]) -> dict:
        heads = [i for i, x in enumerate(lines) if self.head.match(x.strip())]
        first = lines[: heads[0]] if heads else lines
        shorter, least, end = [], None, len(first)
        for i, line in enumerate(first):
            v = self.numbers(line)
            if v is None:
                end = i
                break
            if least is None or len(v) < least:
                least = len(v)
                shorter.append([i, least])
        out = {"heads": len(heads), "shorter": shorter, "end": end, "whole": end == len(first)}
        if heads:
            rest = lines[heads[-1] + 1 :]
            names = lines[heads[-1]].lower().split()
            row = self.good(rest, len(names))
            out |= {"names": names, "row": row, "open": row == len(rest)}
        return out

    def step(self, state: dict, summary: dict) -> dict:
        if summary["heads"]:
            return {"block": state["block"] + summary["heads"], "names": summary["names"], "row": summary["row"], "open": summary["open"]}
        if not state["open"]:
            return state
        short = next((i for i, n in summary["shorter"] if n < len(state["names"])), None)
        return state | {"row": state["row"] + (summary["end"] if short is None else short), "open": summary["whole"] and short is None}

    def rows(self, state: dict, lines: list[str], more: list[str], last: dict) -> Iterator[dict]:
        number_, names, row, is_open = state["block"], state["names"], state["row"], state["open"]
        for line in lines:
            if self.head.match(line.strip()):
                number_, names, row, is_open = number_ + 1, line.lower().split(), 0, True
            elif is_open:
                v = self.numbers(line)
                if v is None or len(v) < len(names):
                    is_open = False
                    continue
                found = {}
                for column, (options, place) in self.columns.items():
                    at = next((names.index(x) for x in options if x in names), None if place is None else place - 1)
                    found[column] = v[at] if at is not None and at < len(v) else None
                yield found | {"block": number_, "row": row, "step": None if found["step"] is None else int(found["step"])}
                row += 1


class NumberedLines:
    """Lines with two numbers or more, and the number of the line (from 0); lines that begin with # are left out."""

    ddl, after = "row long, x double, y double", 0

    def start(self) -> int:
        return 0

    def summarise(self, lines: list[str], more: list[str]) -> int:
        return len(lines)

    def step(self, state: int, summary: int) -> int:
        return state + summary

    def rows(self, state: int, lines: list[str], more: list[str], last: int) -> Iterator[dict]:
        for row, line in enumerate(lines, state):
            words = re.split(r"[\s,]+", line.strip())
            if not words[0].startswith("#") and len(words) > 1 and (x := number(words[0])) is not None and (y := number(words[1])) is not None:
                yield {"row": row, "x": x, "y": y}
