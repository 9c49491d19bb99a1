"""Word lists, patterns and tables that define the operators' results. Plain text, in natural order."""

from __future__ import annotations

# Headings that stand alone on a line.
SECTION_KEYWORDS = (
    "abstract", "introduction", "background", "objective", "objectives", "aim", "aims", "hypothesis", "methods", "methodology",
    "materials and methods", "results", "results and discussion", "discussion", "conclusion", "conclusions", "summary", "references", "reference", "bibliography",
    "acknowledgements", "acknowledgments", "acknowledgement", "funding", "limitations", "future work", "future directions", "contact", "contact information",
)

# Single words that make up a section label.
SECTION_LABELS = (
    "introduction", "intro", "background", "objective", "objectives", "aim", "aims", "method", "methods", "methodology", "materials", "approach",
    "result", "results", "discussion", "conclusion", "conclusions", "abstract", "summary", "references", "acknowledgements", "acknowledgments",
    "future work", "limitations", "contact",
)

# Capital labels inside a line that begin a section.
INLINE_LABELS = (
    "REFERENCES", "REFERENCE", "BIBLIOGRAPHY", "ABBREVIATIONS", "DISCLOSURES", "DISCLOSURE", "ACKNOWLEDGEMENTS", "ACKNOWLEDGMENTS", "FUNDING",
    "CONFLICTS OF INTEREST", "CONFLICT OF INTEREST", "COMPETING INTERESTS", "CORRESPONDING AUTHOR", "CONTACT", "CONCLUSIONS", "CONCLUSION",
)

# Template strings that stand for missing content.
PLACEHOLDERS = (
    "name of conference", "conference name", "city, country", "conference organizer or institution name", "institution name", "complete verbatim text",
    "table not found in the poster text", "no table found", "no tables found", "table not found", "not found in poster",
    "figure 1. caption text", "table 1. caption text", "caption text", "figure caption", "table caption", "yyyy-mm-dd", "yyyy",
    "http://example.com", "https://example.com", "conference url", "poster title", "main poster title", "institution", "affiliation", "university name", "organization name",
    "a 3-4 sentence summary of the full poster", "3-4 sentence summary of the full poster", "full verbatim text of this section from the poster", "full verbatim text of this section",
)

# Template names, by their letters and commas.
PLACEHOLDER_NAMES = (
    "lastname,firstname", "firstname,lastname", "lastname", "firstname", "firstnamelastname", "lastnamefirstname", "familyname,givenname", "givenname,familyname",
    "familyname", "givenname", "family,given", "given,family", "last,first", "first,last", "authorname", "author", "name", "fullname",
)

# Schemes of identifiers with their addresses.
SCHEMES = {
    "orcid": ("ORCID", "https://orcid.org"), "doi": ("DOI", "https://doi.org"), "arxiv": ("arXiv", "https://arxiv.org/abs"), "ror": ("ROR", "https://ror.org"),
    "isni": ("ISNI", "https://isni.org"), "grid": ("GRID", "https://grid.ac"), "crossref_funder": ("Crossref Funder ID", "https://doi.org/10.13039"),
}

# Patterns of identifiers in running text; the value is group 1.
IN_TEXT = {
    "crossref_funder": r"(?:https?://doi\.org/)?10\.13039/(\d+)\b",
    "orcid": r"(?:https?://orcid\.org/)?((?:\d{4}-){3}\d{3}[\dX])\b",
    "doi": r"""(?i)(?:(?:https?://)?(?:dx\.)?doi\.org/|doi:\s*)(10\.\d{4,9}/[^\s,;"'}\]>]+)""",
    "arxiv": r"(?i)(?:arXiv:\s*|(?:https?://)?arxiv\.org/abs/)(\d{4}\.\d{4,5}(?:v\d+)?)",
    "ror": r"https?://ror\.org/(0[a-z0-9]{6}\d{2})\b",
    "isni": r"https?://isni\.org/isni/(\d{15}[\dX])\b",
    "grid": r"https?://grid\.ac/(grid\.\d+\.\w+)\b",
}

# Patterns by which a whole value shows its scheme, in order of precedence.
OF_VALUE = (
    ("orcid", r"^(?:https?://orcid\.org/)?(?:\d{4}-){3}\d{3}[\dX]$"),
    ("crossref_funder", r"^(?:https?://doi\.org/)?10\.13039/"),
    ("doi", r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)?\s*10\.\d{4,9}/"),
    ("arxiv", r"(?i)^(?:arXiv:|(?:https?://)?arxiv\.org/abs/)"),
    ("ror", r"^https?://ror\.org/"),
    ("isni", r"^https?://isni\.org/isni/"),
    ("grid", r"^https?://grid\.ac/"),
)
DOI_PREFIX = r"(?i)^\s*(?:(?:https?://)?(?:dx\.)?doi\.org/|doi:\s*)"

# Address of the scheme of each type of funder identifier.
FUNDER_SCHEMES = {"ROR": "https://ror.org", "Crossref Funder ID": "https://doi.org/10.13039", "GRID": "https://www.grid.ac", "ISNI": "https://isni.org"}

# Rights statements that are known but have no license id.
KNOWN_RIGHTS = ("in copyright", "all rights reserved", "copyright not evaluated", "copyright undetermined", "other-at", "other-open", "other-closed", "other-nc", "other-pd", "other")

# Patterns of texts that are no rights statement (case does not count).
RIGHTS_JUNK = (
    r"^(license|rights|copyright|null|not specified|unknown)$", r"^(creative commons|creative commons license|cc-nc|cc nc)$", r"^sectionTitle$|^sectionContent$",
    r"RESEARCH POSTER PRESENTATION DESIGN", r"PosterPresentations\.com", r"^Copyright\s+\d{4}", r"has received funding from|is funded by", r"Funded by the European Union",
    r"does not necessarily reflect", r"does not necessarily represent", r"Practice Abstract reflects only", r"^https?://(?!creativecommons\.org)", r"Retrievable, Reusable, Repeatable",
    r"^Universiteit\b|^University\b|^SRUC\b", r"collabchem\.com", r"Horizon\s+(2020|Europe)", r"grant\s+agreement", r"innovation programme", r"Environmental Protection Agency",
    r"views expressed in this", r"endorsed by|endorsement", r"Deutsche Forschungsgemeinschaft", r"Norwegian Financial Mechanism", r"zenodo-freetoread", r"National Science Foundation",
    r"Murray.Darling Basin", r"Helmholtz Association", r"^@\w+$", r"^Open Access$", r"This (project|material|work) is supported", r"based upon work supported by", r"^cc-?nc$",
    r"POSTER PRESENTATION TEMPLATE", r"poster template was developed", r"Forschungsgemeinschaft|Forschungsdateninfrastruktur", r"Helmholtz (Alliance|Young)",
    r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", r"^Copyright\s+(©\s*)?\w", r"postersession\.com", r"co-?funded with taxes|state parliament", r"L\s*A\s*T\s*E\s*X\s*Tik\s*Z", r"Science Foundation Ireland",
)
#: Whatever a pattern of these without a ^ matches has one of these in it, in lower case.
JUNK_MARKS = (
    "poster", "fund", "parliament", "does not necessarily", "abstract reflects", "retrievable", "collabchem", "horizon", "grant", "programme", "protection agency", "views expressed", "endorse",
    "forschung", "norwegian", "zenodo", "science foundation", "murray", "helmholtz", "supported", "tik",
)

# License id, name, address and further names.
LICENSES = (
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International", "https://creativecommons.org/licenses/by/4.0/", (
        "CC-BY-4.0", "cc-by", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0",
        "Creative Commons Attribution 4.0 International (CC BY 4.0)", "Attribution 4.0 International", "Creative Commons Namensnennung 4.0 International Lizenz",
        "Creative Commons Namensnennung 4.0 International Lizenz (CC BY 4.0)", "Creative Commons Namensnennung 4.0 International (CC BY 4.0)", "Creative Commons Namensnennung 4.0 International",
        "This work is licensed under a Creative Commons Attribution 4.0 International License", "Attribution 4.0 International (CC BY 4.0)", "Creative Commons Attribution 4.0 License")),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "https://creativecommons.org/licenses/by-sa/4.0/", (
        "CC-BY-SA-4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International License", "Attribution-ShareAlike 4.0 International")),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "https://creativecommons.org/licenses/by-nc/4.0/", (
        "CC-BY-NC-4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution-NonCommercial 4.0 International")),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", "https://creativecommons.org/licenses/by-nd/4.0/", (
        "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "https://creativecommons.org/licenses/by-nc-sa/4.0/", (
        "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "https://creativecommons.org/licenses/by-nc-nd/4.0/", (
        "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License")),
    ("CC-BY-3.0", "Creative Commons Attribution 3.0 Unported", "https://creativecommons.org/licenses/by/3.0/", ("CC-BY-3.0", "cc-by-3.0-us", "Creative Commons Attribution 3.0", "Creative Commons Attribution 3.0 Unported")),
    ("CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported", "https://creativecommons.org/licenses/by-sa/3.0/", ("CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported")),
    ("CC-BY-2.0", "Creative Commons Attribution 2.0 Generic", "https://creativecommons.org/licenses/by/2.0/", ("CC-BY-2.0",)),
    ("CC0-1.0", "Creative Commons Zero 1.0 Universal", "https://creativecommons.org/publicdomain/zero/1.0/", ("CC0-1.0", "CC0", "cc-zero", "Creative Commons Zero 1.0 Universal", "Creative Commons Zero", "Public Domain Dedication", "Public Domain")),
    ("MIT", "MIT License", "https://opensource.org/licenses/MIT", ("MIT", "MIT License")),
    ("Apache-2.0", "Apache License 2.0", "https://www.apache.org/licenses/LICENSE-2.0", ("Apache-2.0", "Apache License 2.0", "Apache License Version 2.0")),
    ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License', "https://opensource.org/licenses/BSD-3-Clause", ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Revised BSD License")),
    ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License', "https://opensource.org/licenses/BSD-2-Clause", ("BSD-2-Clause", "Simplified BSD License")),
    ("GPL-3.0", "GNU General Public License v3.0", "https://www.gnu.org/licenses/gpl-3.0.html", ("GPL-3.0", "GPLv3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("GPL-2.0", "GNU General Public License v2.0", "https://www.gnu.org/licenses/gpl-2.0.html", ("GPL-2.0", "GPLv2", "GNU General Public License v2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0", "https://www.gnu.org/licenses/lgpl-3.0.html", ("LGPL-3.0", "LGPLv3", "GNU Lesser General Public License v3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("MPL-2.0", "Mozilla Public License 2.0", "https://www.mozilla.org/MPL/2.0/", ("MPL-2.0", "Mozilla Public License 2.0")),
)
# Parts of addresses of Creative Commons licenses.
CC_SLUGS = {"by": "CC-BY", "by-sa": "CC-BY-SA", "by-nc": "CC-BY-NC", "by-nd": "CC-BY-ND", "by-nc-sa": "CC-BY-NC-SA", "by-nc-nd": "CC-BY-NC-ND", "zero": "CC0"}

# Stems that mark an institution, in address tails and in names.
INSTITUTION = r"(?i)(univers|institut|instituto|departa|department|dipart|division|divisi|school|escuela|colleg|hospital|clinic|laborator|cent(?:er|re|ro)|zentrum|facult|academ|foundation|fundac|research|hochschule|polytechni)"

# Characters that are deleted, or become a blank, a quote or a dash.
INVISIBLE = "‎‏‪‫‬‭‮⁦⁧⁨⁩​‌‍﻿­"
EXOTIC_BLANKS = "              　"
SINGLE_QUOTES = "‘’‛′‹›‚"
DOUBLE_QUOTES = "“”„‟«»〝〞〟＂"
DASHES = "‐‑‒–—―−"
REQUIRED_FIELDS = ("creators", "titles", "publicationYear", "subjects", "descriptions", "conference", "formats")
NO_FIELD = ("", "other", "unknown", "n/a", "na", "none", "research field", "domain", "field")
