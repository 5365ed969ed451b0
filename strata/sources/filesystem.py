"""Files of any Hadoop file system, through the session's JVM."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from strata.errors import FileAlreadyExistsError, IllegalArgumentException, SparkSessionNotStarted

MODES = ("append", "overwrite", "error_if_exists")


def active_session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise SparkSessionNotStarted
    return spark


def _open(path: str):
    """(file system, path) in the JVM. A checksum file system cannot append, so the one below it is taken."""
    spark = active_session()
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem").isInstance(fs):
        fs = fs.getRawFileSystem()
    return fs, where


def read_file(path: str, encoding: str = "utf8") -> str:
    """Whole content of a text file."""
    fs, where = _open(path)
    if not fs.exists(where):
        raise FileNotFoundError(f"The file {path} was not found.")
    stream = fs.open(where)
    try:
        return bytes(active_session()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(encoding)
    finally:
        stream.close()


def write_file(text: str, path: str, mode: str = "error_if_exists", encoding: str = "utf8") -> None:
    """Write text to a file. mode: append, overwrite or error_if_exists."""
    if mode not in MODES:
        raise IllegalArgumentException(f"Invalid write mode: {mode}. Accepted modes are: {', '.join(MODES)}.")
    fs, where = _open(path)
    exists = fs.exists(where)
    if exists and mode == "error_if_exists":
        raise FileAlreadyExistsError(f"The file {path} already exists.")
    stream = fs.append(where) if exists and mode == "append" else fs.create(where, True)
    try:
        stream.write(bytearray(text.encode(encoding)))
    finally:
        stream.close()


def copy_to_local_file(source_path: str, dest_path: str, delete_source: bool = False) -> None:
    fs, where = _open(source_path)
    target = active_session()._jvm.org.apache.hadoop.fs.Path(dest_path)
    fs.copyToLocalFile(delete_source, where, target, True)


def copy_to_local_folder(source_folder: str, dest_folder: str, delete_source: bool = False) -> None:
    """Copy all files below a folder to a local folder, with their relative paths."""
    fs, where = _open(source_folder)
    base = fs.getFileStatus(where).getPath().toUri().getPath().rstrip("/")
    for path in recursively_list_all_files_in_folder(source_folder):
        plain = active_session()._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
        copy_to_local_file(path, dest_folder.rstrip("/") + plain[len(base) :], delete_source)
    if delete_source:
        fs.delete(where, True)


def recursively_list_all_files_in_folder(folder_path: str) -> Iterator[str]:
    """Paths of all files below a folder."""
    fs, where = _open(folder_path)
    files = fs.listFiles(where, True)
    while files.hasNext():
        yield files.next().getPath().toString()
