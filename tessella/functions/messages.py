"""Validation of message rows: the first rule that fails, or ``ok``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import compatible_version, device_name_problem, first_failure, folder_id_problem, message_path_problem


def _named(problem: Column, prefix: str) -> tuple[Column, Column]:
    return problem != "ok", F.concat(F.lit(f"{prefix}_"), problem)


def _bad_hashes(hashes: Column) -> Column:
    return ~F.forall(hashes, lambda h: F.octet_length(h) == 32)


def hello_problem(version: Column, device_name: Column, device_id: Column, capabilities: Column) -> Column:
    """device_id is binary; at most 100 capabilities of at most 256 bytes."""
    too_long = F.exists(capabilities, lambda c: F.octet_length(c) > 256)
    return first_failure((version == "", "version_missing"), (~compatible_version(version), "version"), _named(device_name_problem(device_name), "device_name"), (F.octet_length(device_id) != 32, "device_id"), ((F.size(capabilities) > 100) | too_long, "capabilities"))


def folder_summary_problem(folder_id: Column, manifest_hash: Column, file_count: Column) -> Column:
    size = F.octet_length(manifest_hash)
    return first_failure(_named(folder_id_problem(folder_id), "folder_id"), ((size > 0) & (size != 32), "manifest_hash"), (file_count > 1_000_000, "file_count"))


def want_problem(folder_id: Column, chunk_hashes: Column) -> Column:
    return first_failure(_named(folder_id_problem(folder_id), "folder_id"), (_bad_hashes(chunk_hashes), "chunk_hash"), (F.size(chunk_hashes) > 1000, "too_many"))


def chunk_data_problem(chunk_hash: Column, data: Column) -> Column:
    size = F.octet_length(data)
    return first_failure((F.octet_length(chunk_hash) != 32, "hash_length"), ((size < 256) | (size > 16 << 20), "size"), (F.unhex(F.sha2(data, 256)) != chunk_hash, "hash_mismatch"))


def file_entry_problem(path: Column, content_hash: Column, chunk_hashes: Column) -> Column:
    return first_failure(_named(message_path_problem(path), "path"), (F.octet_length(content_hash) != 32, "content_hash"), (F.size(chunk_hashes) > 100_000, "too_many_chunks"), (_bad_hashes(chunk_hashes), "chunk_hash"))


def manifest_problem(folder_id: Column, file_count: Column, first_file_problem: Column, manifest_hash: Column) -> Column:
    """first_file_problem: of the first entry with one, else ``ok``."""
    return first_failure(_named(folder_id_problem(folder_id), "folder_id"), (file_count > 1_000_000, "file_count"), _named(first_file_problem, "file"), (F.octet_length(manifest_hash) != 32, "manifest_hash"))
