"""Word lists, patterns and label sets that results depend on. All are defaults of parameters."""

#: Hedge phrases.
HEDGES = ("some say", "it may be understood", "it seems", "according to", "if one grants", "it may be supposed", "some have held", "it would seem", "it may be asked", "one may suppose")
#: Phrases searched for as they stand.
EXACT_PHRASES = ("earth moves", "earth revolves", "earth orbits", "earth rotates", "earth's orbit", "earth's motion", "earth goes around", "earth circles", "earth travels around", "sun at the center", "sun in the center", "sun is the center", "center of the solar system", "heliocentric", "copernicus", "galileo", "kepler", "giordano bruno")
#: Pairs of words searched for with up to five words between them.
PROXIMITY_PAIRS = (("earth", "moves"), ("earth", "revolves"), ("earth", "orbits"), ("earth", "rotates"), ("earth", "circles"), ("earth", "travels"), ("earth", "swinging"), ("earth", "orbit"), ("earth", "motion"), ("moves", "sun"), ("revolves", "sun"), ("orbits", "sun"), ("around", "sun"), ("sun", "center"), ("sun", "middle"))
#: Title and subject words that exclude a book.
SCIENCE = ("science", "astronomy", "physics", "cosmology", "heliocentr", "copernic", "newton", "kepler", "telescope", "gravitation", "astronomical", "astronomer", "orb", "mechanics")
#: Words of three book categories.
ASTRONOMY = ("astronomy", "astronomical", "astrolog", "sphere", "sphaera", "celestial", "heavens", "planets", "planet", "sun", "moon", "stars", "zodiac", "eclipse", "epicycle", "equant", "deferent", "ptolemy", "almagest", "cosmology", "cosmos", "orb", "orbit", "comet", "calendar", "almanac", "chronology", "navigation", "latitude", "longitude", "meteorology")
NATURAL_PHILOSOPHY = ("physics", "nature", "natural philosophy", "meteor", "elements", "motion", "de caelo", "de mundo")
BANNED = ("copernic", "heliocentr", "kepler", "newton", "galileo", "telescope", "gravitation")

#: Sentence rules (Java syntax; (?U) gives the classes their Unicode meaning).
STRONG = r"(?iuUs)\bheliocentric\b|\bearth(?:'s)?\s+(?:orbit|motion|revolution|rotation)\b.{0,140}\b(?:sun|around)\b|\bearth\b.{0,140}\b(?:orbits?|revolves?|rotates?|circles?|travels?|goes around)\b.{0,140}\b(?:sun|around)\b|\bsun\b.{0,80}\b(?:center|centre|middle)\b.{0,120}\b(?:solar system|universe|system)\b|\bcenter of the solar system\b"
HISTORICAL = r"(?iuU)\b(copernicus|galileo|kepler|giordano\s+bruno)\b"
WEAK = r"(?iuUd)\b(earth\s+(?:moves|revolves|orbits|rotates|circles|travels)|earth(?:'s)?\s+(?:orbit|motion)|(?:moves|revolves|orbits)\b.{0,50}\bsun\b|around\b.{0,50}\bsun\b|sun\b.{0,50}\b(?:center|centre|middle)\b)"
FIGURATIVE = r"(?iuU)\b(beneath\s+my\s+feet|with\s+me|as\s+if\s+the\s+earth\s+move|the\s+earth\s+seemed\s+to\s+move|the\s+earth\s+shook|my\s+heart|poem|song)\b"
TECHNICAL = r"(?iuU)\b(epicycle|epicycles|deferent|equant|eccentric|ptolemaic|geocentric)\b"
CONTEXT = r"(?iuU)\b(orbit|planet|solar\s+system|heliocentric|geocentric|astronom|sun|earth)\b"

#: Line rules of the text cleaner.
START_LINE = r"(?iuU)^\*{3}\s*START OF (?:THIS|THE) PROJECT GUTENBERG"
END_LINE = r"(?iuU)^\*{3}\s*END OF (?:THIS|THE) PROJECT GUTENBERG"
METADATA = r"(?iuU)\b(project gutenberg|e-?text|ebook|release date|updated editions?|copyright|all rights reserved|digiti[sz]ed|proofread|transcriber(?:'s)? notes?|produced by|distributed proofreaders|millennium fulcrum edition|character set encoding|language:\s|title:\s|author:\s|editor:\s|http://|https://|www\.)\b"
TOC_HEADER = r"(?iuU)^\s*(table of contents|contents?|index)\s*[:.]?\s*$"
TOC_ENTRY = r"(?iuU)^\s*((chapter|book|part|section)\s+[ivxlcdm0-9]+[a-z]?[.:)]?|[ivxlcdm0-9]+\.\s+|(preface|introduction|appendix|prologue|epilogue)\b)"
TOC_DOTTED = r"(?U)\.{2,}\s*\d+\s*$"
TOC_NUMBER = r"(?U)\s\d+\s*$"
STRUCTURAL = r"(?iuU)^\s*((chapter|book|part|section)\s+[ivxlcdm0-9]+[a-z]?[.:)]?|[-–—]?\s*\d{1,4}\s*[-–—]?|page\s+\d{1,4})\s*$"
BRACKETED = r"(?iuU)\[(?:\s*(?:footnote|note|notes|sidenote|editor(?:'s)?\s+note|transcriber(?:'s)?\s+note)\b[^\]]*|\s*(?:see\s+figure|figure|fig\.|illustration|plate)\b[^\]]*|\s*\d{1,3}\s*)\]"
PARENTHESISED = r"(?iuU)\(\s*(?:see\s+figure|figure|fig\.|footnote|cf\.)\b[^)]*\)"
#: Markers of transcribed books, in three strictnesses.
ANY_START, ANY_END = r"(?iU)\*\*\*\s*START", r"(?iU)\*\*\*\s*END"
CORE_START = r"(?iumUd)^\*{3}\s*START OF\s+(?:THE|THIS)\s+PROJECT\s+GUTENBERG\s+EBOOK.*?\*{3}\s*$"
CORE_START_LOOSE = r"(?iumUd)^\*{3}\s*START OF.*?PROJECT\s+GUTENBERG.*?\*{3}\s*$"
CORE_END = r"(?iumUd)^\*{3}\s*END OF\s+(?:THE|THIS)\s+PROJECT\s+GUTENBERG(?:\s+EBOOK)?.*?\*{3}\s*$"
CORE_END_LOOSE = r"(?iumUd)^\*{3}\s*END OF.*?PROJECT\s+GUTENBERG.*?\*{3}\s*$"

#: Lines that a two-column page reader skips.
HEADINGS = (r"^Book\s+[IVXLCDM]+", r"^The\s+Etymologies", r"^Grammar\b", r"^Mathematics\b", r"^I\.", r"^[IVXLCDM]+\.\S*\s*\d+$", r"^[ivxlcdmIVXLCDM]+\.", r"^[A-Z][A-Za-z\s\-]+\(De ", r"^Page\s+\d+")

#: Label sets of judged generations.
EXPLICIT = ("none", "earth_moves", "earth_stationary", "unclear")
PROTO = ("none", "weak", "strong", "unclear")
STANCE = ("geocentric", "heliocentric_or_earth_moves", "ambiguous", "no_relevant_claim")
REFINED = ("geocentric", "heliocentric", "ambiguous", "hybrid_or_contradictory", "irrelevant_or_unclear")
MOTION_CONTEXT = ("none", "clear_heliocentric", "rotation_only", "ambiguous_or_mixed", "premodern_sphere_context", "unclear")
REGISTER = ("none", "weak", "strong")
STANCE_NAMES = {"geocentric": "geocentric", "heliocentric_or_earth_moves": "heliocentric", "ambiguous": "ambiguous", "no_relevant_claim": "irrelevant_or_unclear"}
VARIANT_PAIRS = (("qwen_base", "qwen_lora500"), ("qwen_base", "qwen_lora1000"), ("qwen_lora500", "qwen_lora1000"))
