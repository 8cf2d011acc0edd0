"""Named databases of one Spark session, and a small command line over them."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lakemill.plans.errors import NameError_
from lakemill.plans.session import Database

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,62}")


@dataclass
class Registry:
    spark: SparkSession
    databases: dict[str, Database] = field(default_factory=dict)

    def create(self, name: str, folder: str | None = None) -> Database:
        """A new database, empty or over a folder of Parquet tables."""
        if not _NAME.fullmatch(name):
            raise NameError_(f"{name!r} is no database name: a letter, then letters, digits and _, 63 at most")
        if name in self.databases:
            raise NameError_(f"database {name} exists")
        self.databases[name] = Database(self.spark) if folder is None else Database.over_parquet(self.spark, folder)
        return self.databases[name]

    def get(self, name: str) -> Database:
        if name not in self.databases:
            raise NameError_(f"database {name} not found")
        return self.databases[name]

    def names(self) -> list[str]:
        return sorted(self.databases)


HELP = r"""\dt  tables    \d NAME  columns    \timing  seconds on or off    \explain SQL  physical plan
\status  session    \help  this text    \q  end    anything else: SQL"""


@dataclass
class Shell:
    """Meta commands and statements to text, as a terminal would show them."""

    db: Database
    timing: bool = False
    open: bool = True

    def run(self, line: str) -> str:
        from lakemill.sources.tables import render

        line, began = line.strip(), time.perf_counter()
        command, _, rest = line.partition(" ")
        if command == r"\dt":
            return render(self.db.list_tables())
        if command == r"\d":
            return render(self.db.describe(rest.strip()))
        if command == r"\timing":
            self.timing = not self.timing
            return f"timing is {'on' if self.timing else 'off'}"
        if command == r"\status":
            return f"{self.db.state}, {len({*self.db.tables, *self.db.files})} tables"
        if command == r"\explain":
            found = self.db.execute(rest)
            return "" if found.rows is None else found.rows._sc._jvm.PythonSQLUtils.explainString(found.rows._jdf.queryExecution(), "formatted")
        if command in (r"\q", r"\quit"):
            self.open = False
            return ""
        if line.startswith("\\"):
            return HELP
        found = self.db.execute(line)
        out = render(found.rows) if found.rows is not None else found.notice or f"{found.kind} {found.count}".strip()
        return out + (f"\n{time.perf_counter() - began:.3f} s" if self.timing else "")
