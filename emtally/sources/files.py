"""Single files on the driver's disk or, named by a URI (hdfs://, s3://, file://), in a store that Spark shares."""

import os
import shutil
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def located(path: str | os.PathLike) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its name there."""
    path = str(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str | os.PathLike) -> bool:
    system, name = located(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def size(path: str | os.PathLike) -> int:
    system, name = located(path)
    return system.get_file_info(name).size


def opened(path: str | os.PathLike) -> pa.NativeFile:
    system, name = located(path)
    return system.open_input_file(name)


@contextmanager
def created(path: str | os.PathLike):
    """A new file to write to; parent folders are made. Where the block fails, what was written goes."""
    system, name = located(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    try:
        with system.open_output_stream(name) as out:
            yield out
    except BaseException:
        remove(path)
        raise


def move(source: str | os.PathLike, target: str | os.PathLike) -> None:
    """Within one file system a rename, else a copy in parts."""
    (a, old), (b, new) = located(source), located(target)
    b.create_dir(os.path.dirname(new), recursive=True)
    if a == b:
        a.move(old, new)
        return
    with opened(source) as found, created(target) as out:
        shutil.copyfileobj(found, out, 1 << 22)
    remove(source)


def remove(path: str | os.PathLike) -> None:
    """Removes a file if it's there."""
    if exists(path):
        system, name = located(path)
        system.delete_file(name)
