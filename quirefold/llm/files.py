"""Files of own formats in the shared folder, by pyarrow's file systems, for use inside tasks."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. A path without a scheme is on a local mount that all share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def attempt_name(suffix: str) -> str:
    """A name that no other attempt of any task uses; only committed ones are listed in the manifest."""
    return f"part-{uuid.uuid4().hex}{suffix}"


def write_bytes(path: str, data: bytes) -> None:
    where, name = at(path)
    with where.open_output_stream(name, compression=None) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    where, name = at(path)
    with where.open_input_stream(name, compression=None) as src:
        return src.read()


def write_manifest(path: str, files: list[dict]) -> None:
    """Lists a job's committed files: one entry for each task that wrote."""
    write_bytes(f"{path}/manifest-{uuid.uuid4().hex}.json", json.dumps(files).encode())


def read_manifests(path: str) -> list[dict]:
    where, name = at(path)
    found = [x.path for x in where.get_file_info(fs.FileSelector(name)) if "/manifest-" in x.path]
    out: list[dict] = []
    for x in sorted(found):
        with where.open_input_stream(x) as src:
            out += json.loads(src.read())
    return out


def drop_files(path: str, names: list[str]) -> None:
    where, base = at(path)
    for name in names:
        try:
            where.delete_file(f"{base}/{name}")
        except OSError:
            pass  # it was never made
