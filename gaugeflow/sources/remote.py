"""Remote files as a Python data source: one partition for each address, failures skipped and told."""

from __future__ import annotations

import ftplib
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT_S = 30


class Address(InputPartition):
    def __init__(self, value: str):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Address]:
        return [Address(a) for a in self.options.get("addresses", "").split("\n") if a.strip()]

    def read(self, partition: Address) -> Iterator[tuple]:
        for name, content, error in fetch(partition.value, self.options):
            yield partition.value, name, content, error


class RemoteFiles(DataSource):
    """format('remote_files'): option addresses, one https, ftp or sftp address a line; user, password, key_file.

    An address that ends with / on ftp or sftp is a folder of which all files are read. sftp needs paramiko
    on the executors, and hosts that are known there.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_files"

    def schema(self) -> str:
        return "address string, name string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetch(address: str, options: dict[str, str]) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, error) of each file at an address."""
    parts = urllib.parse.urlparse(address)
    name = parts.path.rsplit("/", 1)[-1]
    try:
        if parts.scheme == "ftp":
            yield from _ftp(parts, options)
        elif parts.scheme == "sftp":
            yield from _sftp(parts, options)
        elif parts.scheme in ("https", "http", "file"):
            with urllib.request.urlopen(address, timeout=TIMEOUT_S) as answer:  # noqa: S310
                yield name, answer.read(), None
        else:
            yield name, None, f"unknown kind of address: {parts.scheme}"
    except Exception as error:  # noqa: BLE001 a failure of one address is told, whatever it is
        yield name, None, str(error)


def _ftp(parts: urllib.parse.ParseResult, options: dict[str, str]) -> Iterator[tuple[str, bytes | None, str | None]]:
    with ftplib.FTP(timeout=TIMEOUT_S) as ftp:  # noqa: S321
        ftp.connect(parts.hostname or "", parts.port or 21)
        ftp.login(options.get("user", ""), options.get("password", ""))
        for path in ftp.nlst(parts.path) if parts.path.endswith("/") else [parts.path]:
            chunks: list[bytes] = []
            try:
                ftp.retrbinary(f"RETR {path}", chunks.append)
                yield path.rsplit("/", 1)[-1], b"".join(chunks), None
            except ftplib.error_perm as error:
                yield path.rsplit("/", 1)[-1], None, str(error)


def _sftp(parts: urllib.parse.ParseResult, options: dict[str, str]) -> Iterator[tuple[str, bytes | None, str | None]]:
    import stat

    import paramiko

    client = paramiko.SSHClient()
    client.load_system_host_keys()
    client.connect(parts.hostname or "", parts.port or 22, options.get("user"), options.get("password"), key_filename=options.get("key_file"), timeout=TIMEOUT_S)
    with client, client.open_sftp() as files:
        folder = parts.path.endswith("/")
        for entry in files.listdir_attr(parts.path) if folder else [files.stat(parts.path)]:
            path = parts.path + entry.filename if folder else parts.path
            if stat.S_ISREG(entry.st_mode or 0):
                with files.open(path) as source_file:
                    yield path.rsplit("/", 1)[-1], source_file.read(), None


def read_remote(spark: SparkSession, addresses: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(RemoteFiles)
    return spark.read.format("remote_files").options(addresses="\n".join(addresses), **options).load()


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder, local or of an object store."""
    return spark.read.format("binaryFile").load(path)


def source(kind: str):
    """The reader of a kind of source: local, s3, https, ftp or sftp."""
    readers = {"local": read_folder, "s3": read_folder, "https": read_remote, "ftp": read_remote, "sftp": read_remote}
    if kind not in readers:
        raise ValueError(f"unknown kind of source: {kind}")
    return readers[kind]


def bucket_and_key(address: str) -> tuple[str, str]:
    """Parts of an s3 address."""
    found = re.match(r"^s3a?://([^/]+)/(.+)$", address)
    if not found:
        raise ValueError("not an s3 address")
    return found[1], found[2]
