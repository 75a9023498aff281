"""Column functions: rounding, hexadecimal chain words, time bins."""

from .chain import abi_word, address, hex_long
from .numeric import fixed3, round3, round6, time_bin

__all__ = ["abi_word", "address", "fixed3", "hex_long", "round3", "round6", "time_bin"]
