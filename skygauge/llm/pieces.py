"""Where texts may be cut without changing what byte-level tokenizers make of them."""

import re

#: White space as the tokenizers' patterns mean it (Unicode's White_Space; fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Segments of a text: no match of the public byte-level pattern crosses their ends.
SAFE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
