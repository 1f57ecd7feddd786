"""Public suffixes, from the list that comes with Spark's HTTP client or from a file of the same format."""

from __future__ import annotations

import os
import zipfile
from dataclasses import dataclass
from functools import lru_cache
from glob import glob

ENTRY = "mozilla/public-suffix-list.txt"
#: Fixed value: the line after which the list has names that registries did not set.
END = "===END ICANN DOMAINS==="


@dataclass(frozen=True)
class Suffixes:
    """Rules by kind: plain suffixes, parents of which every child is one, and children that are none after all."""

    plain: frozenset[str]
    wild: frozenset[str]
    exceptions: frozenset[str]

    def labels(self, host: str) -> int:
        """Number of labels of the host's public suffix; 0 without one. The longest rule holds."""
        parts = host.split(".")
        for k in range(len(parts)):
            name, rest = ".".join(parts[k:]), ".".join(parts[k + 1 :])
            if name in self.exceptions:
                return len(parts) - k - 1
            if name in self.plain or (rest and rest in self.wild):
                return len(parts) - k
        return 0

    def registered(self, host: str) -> str:
        """The label before the suffix, a dot and the suffix; a host without suffix keeps its last label and the dot."""
        parts, n = host.split("."), self.labels(host)
        return ".".join(([parts[-n - 1]] if n < len(parts) else [""]) + (parts[-n:] if n else [""]))

    def of_length(self, n: int) -> list[str]:
        return sorted(s for s in self.plain if s.count(".") == n - 1)


def parse(text: str) -> Suffixes:
    """The list's registry section; names beyond ASCII count in both spellings."""
    rules = set()
    for line in text.partition(END)[0].splitlines():
        rule = line.strip()
        if rule and not rule.startswith("//"):
            rules.add(rule)
            if not rule.isascii():
                try:
                    rules.add(rule.encode("idna").decode())
                except UnicodeError:
                    pass
    return Suffixes(frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r.startswith("!")))


@lru_cache(maxsize=4)
def load(path: str | None = None) -> Suffixes:
    """The rules of the file at path, else of the list inside Spark's jars."""
    if path is not None:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in sorted(glob(f"{home}/jars/httpclient-*.jar") + glob(f"{os.path.dirname(pyspark.__file__)}/jars/httpclient-*.jar")):
        with zipfile.ZipFile(jar) as z:
            if ENTRY in z.namelist():
                return parse(z.read(ENTRY).decode("utf-8"))
    raise FileNotFoundError("no list of public suffixes among Spark's jars; name a file")
