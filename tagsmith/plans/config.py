"""Configurations: INI files of generators and a scorer."""

from __future__ import annotations

import configparser
import hashlib
import re
from dataclasses import dataclass, field, replace

from tagsmith.sources.readers import literal

#: Arguments that keep texts with # or quotes as they are written.
_COMMENT = re.compile(r"""^((?:[^'"#]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")*?)\s+#.*$""", re.S)


def value(text: str):
    """A configuration value: the comment goes, then a Python literal or a text."""
    m = _COMMENT.match(text)
    return literal((m[1] if m else text).strip())


@dataclass(frozen=True)
class PipelineConfig:
    """generators: section name to (type, arguments), in the order of their labels."""

    generators: dict[str, tuple[str, dict]]
    scorer: str = "StatisticalNGramAnomaly"
    scorer_arguments: dict = field(default_factory=dict)
    count_column: str | None = None

    @staticmethod
    def from_string(text: str) -> PipelineConfig:
        parser = configparser.RawConfigParser()
        parser.optionxform = str
        parser.read_string(text)
        if any(k.lower() == "generator_type" for k in parser.defaults()):
            raise ValueError("generator_type in [DEFAULT] would make every section a generator")
        sections = {s: {k: value(v) for k, v in parser.items(s)} for s in parser.sections()}
        scoring, general = dict(sections.get("AnomalyScoring", {})), sections.get("GENERAL", {})
        generators = {s: (str(o["generator_type"]), {k: v for k, v in o.items() if k != "generator_type"}) for s, o in sections.items() if "generator_type" in o}
        count = general.get("count_column")
        return PipelineConfig(generators, str(scoring.pop("scoring_algorithm", "StatisticalNGramAnomaly")), scoring, None if count in (None, "") else str(count))

    @staticmethod
    def from_file(path: str) -> PipelineConfig:
        with open(path, encoding="utf-8") as f:
            return PipelineConfig.from_string(f.read())

    def select(self, sections: list[str] | None = None, scorer: str | None = None, **scorer_arguments) -> PipelineConfig:
        """Some of the sections, perhaps with another scorer."""
        missing = set(sections or ()) - set(self.generators)
        if missing:
            raise KeyError(f"no sections {sorted(missing)}")
        kept = {s: g for s, g in self.generators.items() if sections is None or s in sections}
        return replace(self, generators=kept, scorer=scorer or self.scorer, scorer_arguments=scorer_arguments if scorer else self.scorer_arguments)

    def to_string(self, header: str = "") -> str:
        lines = [header, ""] if header else []
        if self.count_column:
            lines += ["[GENERAL]", f"count_column = {self.count_column}", ""]
        for section, (kind, arguments) in self.generators.items():
            lines += [f"[{section}]", f"generator_type = {kind}", *(f"{k} = {v}" for k, v in arguments.items()), ""]
        return "\n".join([*lines, "[AnomalyScoring]", f"scoring_algorithm = {self.scorer}", *(f"{k} = {v}" for k, v in self.scorer_arguments.items()), ""])

    def md5(self) -> str:
        return hashlib.md5(self.to_string().encode(), usedforsecurity=False).hexdigest()
