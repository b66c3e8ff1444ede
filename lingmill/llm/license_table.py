"""Makes license_digests.tsv, the shipped table of whole licence texts, from license_texts: python -m lingmill.llm.license_table.

Each text is taken with and without its title and appendix, in its usual wordings, and in many wrappings: as published, a line
a paragraph, all in one line, and wrapped at 64 to 100 columns, as the canonical form drops lines that begin with "copyright".
"""

from __future__ import annotations

import hashlib
import re
import textwrap
from functools import cache
from pathlib import Path

from .licenses import COPYRIGHT, ISC, LOWER, MIT, OTHER, SPELLINGS, UPPER

HERE = Path(__file__).parent
COLUMNS = range(64, 101)
#: Columns by which the lines of a list item are narrower.
HANGS = (0, 2, 3)
#: A canonical text shorter than this is no whole licence.
LEAST = 300

BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of the <organization> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {for_} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_WHO = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "<COPYRIGHT HOLDER> BE LIABLE"),
)
ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def canonical(text: str) -> str:
    """The canonical form of licenses.canonical, in Python."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    text = re.sub(COPYRIGHT, r"\1", text)
    text = re.sub(OTHER.replace(r"\x{80}", "\x80").replace(r"\x{10FFFF}", "\U0010ffff"), " ", text)
    return re.sub("[ \n]+", " ", text).strip(" ")


@cache
def _folded(paragraph: str, columns: int) -> str:
    return canonical(textwrap.fill(paragraph, columns, break_long_words=False, break_on_hyphens=False))


def wrapped(text: str) -> set[str]:
    """The canonical forms of text in all wrappings. Lines keep to themselves, so a form is that of its paragraphs."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[^\S\n]*\n|\n(?=[ \t]*(?:[0-9]+\.|\*|\([0-9]\))[ \t])", text) if p.strip()]
    forms = {canonical(text), canonical(" ".join(paragraphs))}
    for n in (10**6, *COLUMNS):
        for hang in HANGS:
            parts = (_folded(p, n - hang * (re.match(r"[0-9]\.|\*|\(", p) is not None)) for p in paragraphs)
            forms.add(" ".join(p for p in parts if p))
    return {f for f in forms if len(f) >= LEAST}


def cuts(text: str, heads: tuple, ends: tuple) -> set[str]:
    """text from its start or one of heads, up to its end or one of ends; an end written "+x" stays in."""
    found = set()
    for h in ("", *heads):
        for e in ("", *ends):
            lo = text.index(h)
            hi = len(text) if not e else text.index(e.lstrip("+"), lo) + (len(e) - 1 if e[0] == "+" else 0)
            found.add(text[lo:hi])
    return found


def titled(text: str, *titles: str) -> set[str]:
    return {text} | {f"{t}\n\n{text}" for t in titles}


def addressed(text: str) -> set[str]:
    """A text of the GNU project with the addresses it has had."""
    place = r"51 Franklin Street, Fifth Floor, Boston, MA +02110-1301 +USA"
    found = {re.sub(place, a, text) for a in ADDRESSES}
    linked = re.sub(place, "<https://fsf.org/>", text, count=1)
    linked = re.sub(r"if not, write to the Free Software\s+Foundation, Inc., " + place, "if not, see <https://www.gnu.org/licenses/>", linked)
    linked = re.sub(r"if not, write to the Free Software Foundation, Inc.,\s+" + place, "if not, see <https://www.gnu.org/licenses/>", linked)
    # the published texts also have other names in the example of a signature
    return found | {linked, linked.replace("Ty Coon", "Moe Ghoul")}


def bsd() -> dict[str, set[str]]:
    found = {"BSD-2-Clause": set(), "BSD-3-Clause": set()}
    titles = {"BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License")}
    for by, for_ in BSD_WHO:
        end = BSD_END.format(by=by, for_=for_).replace("BE LIABLE BE LIABLE", "BE LIABLE")
        for name, items in [("BSD-2-Clause", BSD_ITEMS), *(("BSD-3-Clause", (*BSD_ITEMS, x)) for x in BSD_NAMES)]:
            for mark in ("{}.", "*"):
                for rights in ("", "All rights reserved.\n\n"):
                    body = "\n\n".join([BSD_HEAD, *(f"{mark.format(i)} {x}" for i, x in enumerate(items, 1)), end])
                    found[name] |= titled(rights + body, *titles[name])
    return found


def texts() -> dict[str, set[str]]:
    """All that counts as the whole text of a licence."""
    got = {p.stem: p.read_text() for p in sorted((HERE / "license_texts").glob("*.txt"))}
    gnu = ("+END OF TERMS AND CONDITIONS", "END OF TERMS AND CONDITIONS")
    out = bsd()
    out["Apache-2.0"] = cuts(got["Apache-2.0"], ("TERMS AND CONDITIONS FOR USE",), ("APPENDIX:", "END OF TERMS AND CONDITIONS"))
    for name in ("GPL-2.0", "LGPL-2.1"):
        out[name] = {c for t in addressed(got[name]) for c in cuts(t, ("Copyright (C)", "Preamble\n"), gnu)}
    out["GPL-3.0"] = cuts(got["GPL-3.0"], ("Copyright (C)", "Preamble\n"), gnu)
    out["LGPL-3.0"] = cuts(got["LGPL-3.0"], ("Copyright (C)", "This version of the GNU Lesser"), ())
    out["MPL-2.0"] = cuts(got["MPL-2.0"], ("1. Definitions",), ("Exhibit B", "Exhibit A - Source"))
    out["CC0-1.0"] = cuts(got["CC0-1.0"], ("CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION", "Statement of Purpose"), ())
    plain = cuts(got["Unlicense"], (), ("For more information",))
    plain |= {t.replace("<http://unlicense.org/>", "<http://unlicense.org>") for t in plain}
    out["Unlicense"] = {u for t in plain for u in titled(t, "The Unlicense", "Unlicense", "The Unlicense (Unlicense)")}
    out["MIT"] = titled(MIT.replace("\n", "\n\n"), "MIT License", "The MIT License", "The MIT License (MIT)", "MIT")
    isc = ISC.replace("\n", "\n\n")
    out["ISC"] = {u for t in (isc, isc.replace("modify, and/or", "modify, and")) for u in titled(t, "ISC License", "The ISC License", "ISC License (ISC)", "ISC")}
    return out


def table() -> dict[str, str]:
    """digest -> licence."""
    found: dict[str, str] = {}
    for name, some in sorted(texts().items()):
        for form in set().union(*map(wrapped, sorted(some))):
            digest = hashlib.sha256(form.encode()).hexdigest()
            if found.setdefault(digest, name) != name:
                raise ValueError(f"{name} and {found[digest]} have the same text")
    return found


if __name__ == "__main__":
    rows = sorted((name, digest) for digest, name in table().items())
    (HERE / "license_digests.tsv").write_text("".join(f"{name}\t{digest}\n" for name, digest in rows))
