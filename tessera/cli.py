"""A command line: python -m tessera.cli DATABASE [-c SQL] [-f FILE] [--mode table|csv|json]."""

from __future__ import annotations

import argparse
import csv
import json
import sys
import time

from pyspark.sql import SparkSession

from .errors import EngineError
from .session import Session

HELP = ".tables  .schema [T]  .read FILE  .output FILE  .mode M  .timer on|off  .echo on|off  .stats  .clear  .quit  .help"


class Shell:
    def __init__(self, session: Session, out=None, mode: str = "table", timer: bool = False, echo: bool = False):
        self.session, self.out, self.mode, self.timer, self.echo = session, out or sys.stdout, mode, timer, echo
        self.failed, self.done, self.statements, self.seconds = False, False, 0, 0.0

    def run(self, text: str) -> None:
        """Statements end with a semicolon outside of texts; a line that starts with a dot is a command."""
        held = ""
        for line in text.splitlines():
            if self.done:
                return
            if not held.strip() and line.strip().startswith("."):
                self.command(line.strip())
                continue
            held += line + "\n"
            *whole, held = _split(held)
            for sql in whole:
                self.statement(sql)
        if held.strip():
            self.statement(held)

    def statement(self, sql: str) -> None:
        if self.echo:
            print(sql.strip(), file=self.out)
        began = time.time()
        try:
            words = sql.split()
            head = words[0].upper() if words else ""
            if head == "COPY":
                self.copy(words)
            elif head == "SELECT":
                self.show(self.session.query(sql))
            else:
                print(f"{self.session.execute(sql)} rows affected", file=self.out)
        except EngineError as error:
            self.failed = True
            print(f"Error: {error}", file=sys.stderr)
        self.statements += 1
        self.seconds += time.time() - began
        if self.timer:
            print(f"{time.time() - began:.3f} s", file=self.out)

    def copy(self, words: list[str]) -> None:
        if len(words) < 4 or words[2].upper() not in ("FROM", "TO"):
            raise EngineError("COPY table FROM file, or COPY table TO file")
        path = words[3].rstrip(";").strip("'")
        if words[2].upper() == "FROM":
            print(f"{self.session.copy_from(words[1], path)} rows copied", file=self.out)
        else:
            self.session.copy_to(words[1], path)

    def show(self, result) -> None:
        if self.mode == "json":
            for row in result.as_maps():
                print(json.dumps(row, ensure_ascii=False), file=self.out)
        elif self.mode == "csv":
            writer = csv.writer(self.out)
            writer.writerow(result.columns)
            writer.writerows(result.rows)
        elif result.is_empty():
            print("No rows returned", file=self.out)
        else:
            rows = [result.columns, *result.rows_as_text()]
            widths = [max(len(r[i]) for r in rows) for i in range(len(result.columns))]
            for row in rows:
                print(" | ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip(), file=self.out)

    def command(self, line: str) -> None:
        name, *args = line.split()
        if name in (".quit", ".exit"):
            self.done = True
        elif name == ".tables":
            print("\n".join(sorted(self.session.schemas())), file=self.out)
        elif name == ".schema":
            for table, columns in self.session.schemas().items():
                if not args or args[0].lower() == table.lower():
                    print(f"{table}: " + ", ".join(f"{c.name} {c.type}" + (f"({c.size})" if c.size else "") for c in columns), file=self.out)
        elif name == ".read" and args:
            with open(args[0]) as f:
                self.run(f.read())
        elif name == ".output":
            self.out = open(args[0], "w") if args else sys.stdout  # noqa: SIM115
        elif name in (".timer", ".echo"):
            setattr(self, name[1:], args[:1] == ["on"])
        elif name == ".mode" and args[:1] in (["table"], ["csv"], ["json"]):
            self.mode = args[0]
        elif name == ".stats":
            print(f"{self.statements} statements, {self.seconds:.3f} s", file=self.out)
        elif name == ".clear":
            print("\033[2J\033[H", end="", file=self.out)
        elif name == ".help":
            print(HELP, file=self.out)
        else:
            self.failed = True
            print(f"Error: unknown command {line}; .help lists them", file=sys.stderr)


def _split(text: str) -> list[str]:
    out, start, quoted, i = [], 0, False, 0
    while i < len(text):
        if quoted and text[i] == "\\":
            i += 1
        elif text[i] == "'":
            quoted = not quoted
        elif text[i] == ";" and not quoted:
            out.append(text[start : i + 1])
            start = i + 1
        i += 1
    return [*out, text[start:]]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("database")
    parser.add_argument("-c", "--command")
    parser.add_argument("-f", "--file")
    parser.add_argument("-o", "--output")
    parser.add_argument("-q", "--quiet", action="store_true")
    parser.add_argument("--mode", choices=("table", "csv", "json"), default="table")
    parser.add_argument("--timer", action="store_true")
    parser.add_argument("--echo", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    out = open(args.output, "w") if args.output else sys.stdout  # noqa: SIM115
    shell = Shell(Session(spark, args.database), out, args.mode, args.timer, args.echo)
    if args.command:
        shell.run(args.command)
    elif args.file:
        with open(args.file) as f:
            shell.run(f.read())
    else:
        if not args.quiet:
            print(HELP, file=out)
        for line in sys.stdin:
            shell.run(line)
            if shell.done:
                break
    out.flush()
    return int(shell.failed)


if __name__ == "__main__":
    sys.exit(main())
