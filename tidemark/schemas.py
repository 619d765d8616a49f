"""Fixed values and schemas of the data model."""

from __future__ import annotations

# The on-disk and protocol constants that results must agree with.
TIER_HOT, TIER_COLD, TIER_MEM = 1, 2, 3
TYPE_MASK, PERM_MASK = 0o170000, 0o7777
MODE_DIR, MODE_REGULAR, MODE_SYMLINK = 0o040000, 0o100000, 0o120000
ROOT_INODE = 1
STRIPE_BYTES, SEGMENT_BYTES = 64 << 20, 1 << 30
#: Bytes of segments and reads travel in pieces of this size.
SLICE_BYTES = 1 << 20
RECORD_MAGIC, RECORD_VERSION, HEADER_BYTES, TRAILER_BYTES = b"PLSE", 1, 40, 4
NODE_FIXED_BYTES, FRAGMENT_BYTES = 58, 40
TARGET_SHARE = 0.8
MAX_CLIMB = 1000
ERRNO = {"ENOENT": 2, "EIO": 5, "EEXIST": 17, "ENOTDIR": 20, "EISDIR": 21, "EINVAL": 22, "ENOTEMPTY": 39, "EPERM": 1}
#: The status of a request that another of its batch stands in the way of; it is this library's own.
EAGAIN = 11
BYTE_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}

FRAGMENTS = "inode BIGINT, stripe_id BIGINT, seq BIGINT, logical_off BIGINT, length BIGINT, tier TINYINT, segment_id BIGINT, segment_offset BIGINT"
NODES = "inode BIGINT, mode INT, nlink BIGINT, uid BIGINT, gid BIGINT, size BIGINT, mtime_ns BIGINT, ctime_ns BIGINT, atime_ns BIGINT, symlink_target STRING"
DIRENTS = "parent BIGINT, name STRING, child BIGINT"
SEGMENTS = "tier TINYINT, segment_id BIGINT, size BIGINT, is_active BOOLEAN"
RECORDS = "segment_id BIGINT, inode BIGINT, stripe_id BIGINT, seq BIGINT, logical_off BIGINT, length BIGINT, payload_off BIGINT, payload BINARY"
