"""Tables as one ordered CSV file: tasks write parts, and the commit joins them in the order of the partitions."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are copied at a time.
CHUNK = 1 << 20
ENDS = {"crlf": "\r\n", "lf": "\n"}


@dataclass
class _Part(WriterCommitMessage):
    place: int
    path: str


def _cell(value: object, whole: bool) -> str:
    """Blank for null; numbers as short as they read back, and without a fraction if they have none and whole says so."""
    if value is None:
        return ""
    if isinstance(value, float):
        return str(int(value)) if whole and value.is_integer() else repr(value)
    return str(value)


class _Writer(DataSourceWriter):
    def __init__(self, options: CaseInsensitiveDict, columns: list[str], overwrite: bool):
        path = options["path"]
        fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.uri, self.columns, self.end = path, columns, ENDS[options.get("newline", "lf")]
        self.whole = set(filter(None, options.get("whole", "").split(",")))
        if not overwrite and fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{path} exists already")
        self.parts = f"{PurePosixPath(self.path).parent}/.{PurePosixPath(self.path).name}-{uuid.uuid4().hex}"
        # here alone, so that a task that ends after an abort leaves nothing
        fs.create_dir(self.parts)

    def _fs(self) -> pafs.FileSystem:
        return pafs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri else pafs.LocalFileSystem()

    def _text(self, rows: Iterator[list[str]]) -> Iterator[bytes]:
        out = io.StringIO()
        w = csv.writer(out, lineterminator=self.end)
        for row in rows:
            w.writerow(row)
            if out.tell() > CHUNK:
                yield out.getvalue().encode()
                out.seek(0)
                out.truncate()
        yield out.getvalue().encode()

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, place = self._fs(), TaskContext.get().partitionId()
        # each attempt of a task has a file of its own; only those of the attempts that count are joined
        path = f"{self.parts}/{place:08d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            for chunk in self._text([_cell(v, c in self.whole) for c, v in zip(self.columns, row, strict=True)] for row in iterator):
                out.write(chunk)
        return _Part(place, path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs = self._fs()
        whole = f"{self.parts}/whole"
        with fs.open_output_stream(whole) as out:
            for chunk in self._text(iter([self.columns])):
                out.write(chunk)
            for part in sorted((m for m in messages if isinstance(m, _Part)), key=lambda m: m.place):
                with fs.open_input_stream(part.path) as f:
                    while chunk := f.read(CHUNK):
                        out.write(chunk)
        fs.move(whole, self.path)
        fs.delete_dir(self.parts)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs = self._fs()
        if fs.get_file_info(self.parts).type != pafs.FileType.NotFound:
            fs.delete_dir(self.parts)


class OrderedCsv(DataSource):
    """One CSV file with a header. Options: path (which driver and tasks share), newline (crlf or lf), whole (columns whose whole numbers have no fraction)."""

    @classmethod
    def name(cls) -> str:
        return "ordered_csv"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.names, overwrite)


def iso(at: Column) -> Column:
    """A UTC time as text, with microseconds only if it has some."""
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def ordered_csv(rows: DataFrame, path: str, newline: str = "lf", whole: list[str] | None = None, force: bool = False) -> None:
    """Writes rows in their order; an existing file is an error unless force."""
    rows.sparkSession.dataSource.register(OrderedCsv)
    w = rows.write.format("ordered_csv").mode("overwrite" if force else "append").option("newline", newline).option("whole", ",".join(whole or []))
    w.option("path", path).save()


_CLEAN = ["venue", "timestamp", "unix_ts", "trade_id", "outcome", "side", "price", "quantity", "notional_usd", "yes_price", "tx_hash", "maker", "taker", "is_block_trade"]


def clean_csv(tape: DataFrame, venue: str, path: str, force: bool = False) -> None:
    """One venue's clean tape in the tape's order; a chain tape from logs has its log index too. Whole quantities of the exchange have no fraction."""
    rows = tape.where(F.col("venue") == venue)
    logs = venue != "kalshi" and not rows.where("log_index IS NOT NULL").isEmpty()
    columns = _CLEAN[:4] + ["log_index"] * logs + _CLEAN[4:]
    order = ["unix_ts", "tx_hash", "log_index"] if logs else ["unix_ts", "trade_id"]
    ordered_csv(rows.orderBy(*order).select(*[iso(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in columns]), path, "crlf", ["quantity"] if venue == "kalshi" else [], force)


def tables_csv(merged: DataFrame, matches: DataFrame, trades: DataFrame, folder: str, force: bool = False) -> None:
    """merged.csv, matches.csv and matched_trades.csv of one event; trades: in their order."""
    ordered_csv(merged.orderBy("timestamp", "id").select("timestamp", "id", "market", "side", "size", "yes_price", "no_price"), f"{folder}/merged.csv", whole=None, force=force)
    ordered_csv(matches.orderBy("match_seq").select("poly_time", "kalshi_time", "poly_yes", "poly_no", "kalshi_yes", "kalshi_no", "arb_size", "poly_side", "kalshi_side"), f"{folder}/matches.csv", force=force)
    ordered_csv(trades.select("timestamp", "market", "trade_id", "side", "size", "yes_price", "no_price"), f"{folder}/matched_trades.csv", force=force)
