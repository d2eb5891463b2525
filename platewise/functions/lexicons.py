"""Word lists of the review and menu rules. All are defaults; every operator takes its own."""

# Review scoring.
POSITIVE_WORDS = (
    "excellent", "amazing", "awesome", "great", "good", "love", "perfect",
    "fresh", "tasty", "delicious", "wonderful", "fantastic", "best",
)
NEGATIVE_WORDS = (
    "poor", "bad", "terrible", "worst", "horrible", "disappointed",
    "cold", "late", "slow", "stale", "awful", "not good",
)
DELIVERY_WORDS = ("delivery", "delivered", "packaging", "packed", "packing")
DELIVERY_NEGATIVE_WORDS = ("late", "poor", "bad", "worst", "damaged")
PRICE_WORDS = ("price", "expensive")

# Spellings that are corrected.
SPELLINGS = {
    "chapathi": "chapati",
    "chappathi": "chapati",
    "laccha": "lachha",
    "rool": "roll",
    "subji": "sabji",
    "dosai": "dosa",
    "dossa": "dosa",
    "idlly": "idli",
    "gateaux": "cake",
    "poori": "puri",
    "pattice": "patties",
}

# Words dropped from a menu name.
NOISE_WORDS = ("special", "spl", "mini", "jumbo", "large", "medium", "small")

# Names that hold several foods but are one item.
SINGLE_ITEMS = (
    "chicken egg biryani", "chicken paratha", "chicken egg roll", "oats apple jar", "palak onion pakoda",
    "strawberry limeade", "bread jam toast", "bread butter jam", "butter toast",
)

# Names too vague to map.
AMBIGUOUS_WORD = "thali"
AMBIGUOUS_NAMES = (
    "chocolate desire heart", "juice of the day", "paneer snacks", "full non veg chicken meal",
    "signature non veg sandwich", "dinner", "variety", "menu", "meal", "lunch", "chapati non veg", "non veg rice",
    "chocolate", "mango", "strawberry", "butterscotch", "blackcurrent",
    "sweet", "sabji", "gravy", "veg dish", "non veg combo",
)
SPECIFIC_NAMES = (
    "desire heart cake", "juice", "chapati", "paratha", "rice", "veg nuggets", "sweet lassi", "hi tea", "choco lava",
    "kaju katli sweet", "aloo sabji", "rice bowl", "mango masti", "chocolate drink", "hot chocolate",
    "apple", "banana", "tea", "biscuit",
)

# Packaged brands, and dishes that count as restaurant dishes all the same.
BRANDS = ("amul", "nestle")
NOT_PACKAGED = (
    "samosa", "pakora", "muffin", "bread", "veg sandwich", "curd", "lemon juice", "kaju katli",
    "sunflower seeds roasted", "belgian milk chocolate", "naughty nutella", "choco truffle",
    "maggie", "horlicks", "boost", "bournvita", "mr chicken tikka burger", "pesto paneer puff",
)

# Our own list; the rule only says that each item is flagged.
NON_VEG_WORDS = (
    "non veg", "nonveg", "chicken", "murg", "mutton", "lamb", "keema", "egg", "fish", "prawn", "crab", "beef", "pork",
    "tuna", "salmon", "shrimp", "lobster", "squid", "bacon", "ham", "sausage", "salami", "pepperoni", "turkey", "duck",
    "meat", "seekh kebab", "kheema",
)

# Our own list: words that end the name of a dish, where a combo lists several without separators.
DISH_WORDS = (
    "manchurian", "noodle", "noodles", "rice", "curry", "gravy", "roti", "naan", "paratha", "biryani", "pulao", "dal",
    "sabji", "roll", "fry", "sandwich", "burger", "pizza", "fries", "soup", "momo", "momos",
)

# Our own list: words that name no food when a name ends with them.
VAGUE_ENDINGS = ("snack", "snacks")

# Unit spellings and their short forms.
UNITS = {
    "millilitre": "ml",
    "litre": "l",
    "liter": "l",
    "milligram": "mg",
    "kilogram": "kg",
    "gram": "g",
    "grm": "g",
    "gm": "g",
    "nos": "no",
    "pcs": "pc",
    "pieces": "piece",
}
UNIT_WORDS = (
    "millilitre", "litre", "liter", "milligram", "kilogram", "gram", "grm", "gm",
    "ml", "mg", "kg", "g", "l", "pieces", "piece", "pcs", "pc", "nos", "no", "packet", "plate",
)
