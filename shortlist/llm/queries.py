"""All queries of this subpackage."""

from shortlist.llm import (  # noqa: F401
    alignment,
    chat,
    decontaminate,
    licenses,
    mixing,
    packing,
    ppm,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    trie,
    windows,
)
from shortlist.llm.registry import ORACLES, QUERIES  # noqa: F401
