"""Closed vocabularies of the data model."""

# fixed values: the vocabularies that inputs and outputs use
CATEGORIES = (
    "tshirts", "polo", "shirts", "sweaters", "hoodies", "jackets", "coats", "pants", "jeans", "shorts",
    "underwear", "socks", "leggings", "bras", "shoes", "generic-body-guide",
)
SYSTEMS = ("FR", "EU", "US", "UK", "IT", "INT", "WAIST_INSEAM", "FOOTWEAR", "SOCK", "BRA")
AUDIENCES = ("men", "women", "kids", "unisex", "unknown")
VARIANTS = ("standard", "regular", "tall", "petite", "unknown")
UNITS = ("cm", "in", "mixed", "unknown")
FIELDS = (
    "chest", "waist", "hips", "inseam", "outseam", "height", "sleeve", "neck", "shoulder", "footLength", "footWidth",
)
KINDS = ("html-table", "aria-grid", "markdown-table", "markdown-grid", "div-grid", "advisory-text")
ORIENTATIONS = ("size-rows", "size-columns", "conversion-grid", "unknown")
STATUSES = ("accepted", "warning", "rejected", "ambiguous")

#: Fields that tops, bottoms and shoes may have.
TOP_FIELDS = ("chest", "waist", "hips", "height", "sleeve", "neck", "shoulder")
BOTTOM_FIELDS = ("waist", "hips", "inseam", "outseam", "height")
SHOE_FIELDS = ("footLength", "footWidth")

TOP_CATEGORIES = ("tshirts", "shirts", "hoodies", "jackets")
BOTTOM_CATEGORIES = ("pants", "jeans", "shorts", "leggings")
