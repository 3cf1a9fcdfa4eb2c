"""Fixed values that results must agree on."""

from __future__ import annotations

# Supported digest algorithms, in canonical (output and packing)
# order; the first one is the default.
ALGOS: tuple[str, ...] = (
    "sha1",
    "md5",
    "adler32",
    "crc32",
    "sha256",
    "sha512",
    "sha3-256",
    "sha3-512",
)
DEFAULT_ALGO = "sha1"

# Length of the hexadecimal digest of each algorithm.
HEX_LENGTH = {
    "sha1": 40,
    "md5": 32,
    "adler32": 8,
    "crc32": 8,
    "sha256": 64,
    "sha512": 128,
    "sha3-256": 64,
    "sha3-512": 128,
}

# Key names and column limits of the legacy layouts.
KEY_PREFIX = "file-checksum-"
KEY_UPDATED_AT = "file-checksum-updated_at"
PENDING_PREFIX = "pending:"
INDEX_VALUE_LENGTH = 63
PACKED_MAX_BYTES = 255

# Rule and queue modes.
MODE_NEW = "new"
MODE_AUTO = "auto"
MODE_MISSING = "missing"
MODE_FORCE = "force"
MODE_LAZY = "lazy"
MODE_OFF = "off"
PENDING_MODES = (MODE_NEW, MODE_MISSING, MODE_AUTO, MODE_FORCE, MODE_LAZY)

# User scope that covers everybody.
SCOPE_ALL = "all"

# Error texts of a failed hashing request.
ERR_NOT_FOUND = "File not found."
ERR_NOT_FILE = "Node is not a file."
ERR_NO_CONTENT = "Content not readable."
ERR_UNSUPPORTED = "Unsupported algorithm: "

# Members of one (algo, hash) group handled by one task before the group is
# split; there can be at most <index rows> / HOT_GROUP_ROWS such groups, which
# bounds every broadcast of them.
HOT_GROUP_ROWS = 1_000_000

# Copies a small unique side is spread over when the other side may be skewed.
SPREAD = 16
