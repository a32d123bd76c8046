"""Word lists, lookup tables and patterns that results depend on."""

# Texts that mean a missing value.
MISSING = ["", "nan", "none", "null", "n/a", "na", "#n/a", "unknown"]

# Words that a title's token set leaves out.
TITLE_STOP = [
    "with", "and", "for", "the", "a", "an", "of", "in", "to", "&", "-", "by", "new", "renewed", "refurbished", "certified", "factory", "serviced",
    "black", "white", "silver", "gray", "grey", "red", "blue", "pink", "teal", "charcoal", "stainless", "steel", "edition", "version", "pack", "includes", "plus",
]

# Weights of the pair score.
PAIR_WEIGHTS = {"jac": 1.0, "cross": 0.35, "price": 0.25, "brand": 0.1, "num": 0.3}

# Model and part codes.
MODEL = r"\b([A-Z]{1,4}\d{2,5}[A-Z0-9]{0,6})\b"
PART = r"\b(\d{3,4}[A-Z]{2,4}\d{3}[A-Z]?|X[A-Z0-9]{5,10}|\d{5,10})\b"
LISTING_ID = r"^B0[0-9A-Z]{8}$"
MODEL_STOP = ["USB2", "USB3", "HEPA13", "H13", "H11", "H12", "UV5", "PM25", "PM2", "CO2", "AA10"]
COMPATIBLE = r"(?i)\b(for|compatible with|compatible|fits|works with|replacement for|replaces)\b"
MODEL_NOISE = r"(?i)\(?factory serviced\)?|\brenewed\b|\bseries\b|[®™]|\bshark\b|\bninja\b"
MODEL_IN_BRACKETS = r"\(([A-Z]{1,4}\d{2,5}[A-Z0-9]{0,6})\)"
MODEL_NAMED = r"\(([A-Z]{1,4}\d{2,5}[A-Z0-9]{0,6})\)|\bMODEL[:#]?\s+([A-Z]{1,4}\d{2,5}[A-Z0-9]{0,6})\b"
MODEL_CORE = r"^([A-Z]{1,4}\d{2,5})"
MODEL_AMAZON_SUFFIX = r"AMZ$"
MODEL_SUFFIX = r"(Q|C|CO|REF|RB|WM|BRN|COST|TGT|QSS|BK|WH|GR)$"
GENERIC_MODEL = r"(?i)^(?=.*[a-z])(?=.*\d)[a-z0-9\-/]{4,}$"
MEASURE = r"(?i)^\d+(\.\d+)?(gb|tb|mb|mp|hz|ghz|mm|cm|in|inch|ft|oz|lb|lbs|w|v|hr|hrs|pack|ct|pc|pcs|x)$"
NUMBER = r"\b\d+(?:\.\d+)?\s?(?:gb|tb|mb|qt|quart|oz|w|watt|cup|inch|in|mm|mp|x)?\b"
BRAND_ALIASES = {"hewlett packard": "hp", "hewlettpackard": "hp", "hewlett-packard": "hp"}
RENEWED = r"(?i)\(renewed\)|\brenewed\b|refurbish|factory serviced"

# Product types by the last category and by the title, first match wins.
CATEGORY_TYPES = [
    (r"Upright Vacuums|Canister Vacuums", "vacuum-upright/canister"), (r"Stick Vacuums", "vacuum-stick"), (r"Handheld Vacuums", "vacuum-handheld"),
    (r"Robotic Vacuums", "vacuum-robot"), (r"Steam Mops$|Steam Cleaners", "steam mop"), (r"Sweepers", "sweeper"), (r"Air Fryers|Deep Fryers", "air fryer"),
    (r"Countertop Blenders|Personal Size Blenders|^Blenders$", "blender"), (r"Food Processors$", "food processor"),
    (r"Coffee Machines|Coffee Makers|Espresso Machines|Drip Coffee", "coffee maker"), (r"Slow Cookers|Electric Pressure Cookers|Multicookers|Rice Cookers", "multicooker"),
    (r"Electric Grills|Indoor Grills|Contact Grills", "indoor grill"), (r"Toaster Ovens|Countertop Ovens|Convection Ovens", "countertop oven"),
    (r"Ice Cream Machines", "ice cream maker"), (r"Air Purifiers", "air purifier"), (r"^Irons$|Steamers", "iron/steamer"),
    (r"Cookware|Skillets|Pans|Knife|Cutlery|Bakeware", "cookware/cutlery"), (r"Hand Blenders", "blender"), (r"Choppers", "food processor"), (r"Mixers", "mixer"),
]
TITLE_TYPES = [
    (r"air fry", "air fryer"), (r"robot", "vacuum-robot"), (r"stick vac|cordless stick|rocket|vertex|wandvac|\bhv\d", "vacuum-stick"),
    (r"handheld|\bhand vac", "vacuum-handheld"), (r"upright|navigator|rotator|lift-?away|canister", "vacuum-upright/canister"),
    (r"steam (pocket )?mop|steam cleaner", "steam mop"), (r"coffee|espresso", "coffee maker"), (r"blender|nutri ninja|auto-?iq|kitchen system|blend", "blender"),
    (r"food processor|chop|master prep|food & drink maker", "food processor"), (r"cooking system|multi ?cooker", "multicooker"), (r"mixer", "mixer"),
    (r"pressure cook|slow cook|foodi|possible ?cooker", "multicooker"), (r"grill", "indoor grill"), (r"oven|toaster", "countertop oven"),
    (r"creami|ice cream", "ice cream maker"), (r"purifier", "air purifier"), (r"\biron\b|steamer", "iron/steamer"),
    (r"cookware|skillet|\bpan\b|knife|knives", "cookware/cutlery"), (r"sweeper", "sweeper"), (r"juicer", "juicer"), (r"kettle", "kettle"), (r"waffle", "waffle maker"),
    (r"cleanser|cleaning solution", "floor-care consumable"), (r"steam", "steam mop"), (r"frother", "coffee maker"), (r"cookbook", "other"), (r"vacuum|\bvac\b|stickvac", "vacuum-other"),
]
CATEGORY_OF_PARTS = r"Parts|Accessories|Attachments|Filters|Replacement"
BUNDLE = r"(?i)(vacuums?|mop|blender|cooker|fryer|grill|steamer)\b[^+]*\+\s*\S"

# Accessory titles.
PART_ANYWHERE = (
    r"(?i)replacement|compatible|\bfor (shark|ninja)\b|part no|\bgenuine\b|\bkit\b|\bfits\b|\brefills?\b|accessory (holder|bag|kit|set)|"
    r"cups? with (sip )?lids|cleaning pad|disc blade|shelf"
)
PART_WORDS = (
    r"\bfilters?\b|\blids?\b|\bpints?\b|\bblades?\b|\bhose\b|nozzle|dust (cup|bin)|dirt bin|brush ?roll|\bbrush(es)?\b|reservoir|\btank\b|\bpads?\b|\bbelts?\b|"
    r"motor base|power base|\bgasket|sealing ring|\bpitcher\b|\bwand\b|\bbowl\b|\battachment\b|\bholder\b|\bgrinder\b|\bsleeve\b"
)
UNIT_NOUNS = (
    r"(?i)vacuum|\bvac\b|blender|coffee (bar|maker|brewer)|air fryer|\bgrill|cooker|oven|steam (pocket )?mop|processor|kitchen system|purifier|\biron\b|sweeper|juicer|"
    r"kettle|creami|ice cream maker|foodi|toaster|steamer|mixer|chop|navigator|rotator|rocket|lift-?away|duoclean|apex|vertex|wandvac|\bion\b|\biq\b|robot|vacmop|nutri (ninja|bowl)|auto-?iq"
)
PART_CODE = r"\b(\d{3,4}[A-Z]{2,4}\d{3}[A-Z]?|X[A-Z]{2,4}\d{2,4}[A-Z]?)\b"

# Makers.
UNRELATED = r"(?i)shark ?skinz|sharkk|ninja brand|ninja rug pad|rug pad|gripper pad|teenage mutant|nickelodeon|buddha|tote bag|canvas bag|soap dispenser|dancing shark|soapstone"
OWN_BRAND = r"(?i)\b(shark|ninja|nutri ninja|sharkninja|euro-?pro)\b"
OWN_LINE = r"(?i)navigator|rotator|rocket|lift-?away|duoclean|mega kitchen system|professional plus kitchen system|foodi|express chop|auto-?iq|nutri|creami|vertex|ionflex|wandvac|\bbl\d{3}|\bsv\d{3,4}|steam pocket"
THIRD_PARTY = r"(?i)^(replacement|compatible|for |fits )|\bcompatible with\b|\breplacement for\b|\bfits\b"
GENUINE = r"(?i)genuine|original|oem"

# Quarts a unit, and watts.
CAPACITY_UNITS = [
    (r"(?i)([\d.]+)\s*-?\s*(?:qt|quarts?)\b", 1.0), (r"(?i)([\d.]+)\s*-?\s*(?:liters?|l)\b", 1 / 0.946353),
    (r"(?i)([\d.]+)\s*-?\s*(?:fl\.? ?oz|fluid ounces?|oz|ounces?)\b", 1 / 32), (r"(?i)([\d.]+)\s*-?\s*cups?\b", 1 / 4), (r"(?i)([\d.]+)\s*-?\s*(?:ml|milliliters?)\b", 1 / 946.353),
]
WATTS = r"(?i)(\d{2,4}(?:\.\d+)?)\s*-?\s*(?:watts?|w)\b"
WATTS_ALONE = r"^\s*(\d{2,4})(?:\.0+)?\s*$"

# Complaint themes.
THEMES = {
    "stopped_working": r"\b(stopped working|quit working|quit on me|died|no longer (works|turns on|runs|charges|heats)|won'?t (turn on|power on|start|charge)|will not (turn on|power on|start|charge)|doesn'?t turn on|does not turn on|stopped (turning on|charging|heating|running|brewing|blending))\b",
    "dead_on_arrival": r"\b(dead on arrival|doa)\b|(never|didn'?t|did not|wouldn'?t|would not) (even )?(work|turn on|power on|start)(ed)? (at all )?(right )?(out of the box|from (the )?(start|beginning|first day|day one))|arrived (dead|not working)|never worked( at all)?[.!]|out of the box.{0,30}(didn'?t|did not|wouldn'?t|would not|won'?t) (work|turn on|power on)",
    "battery_runtime": r"\b(battery (life|died|dies|won'?t|doesn'?t|only|lasts?|drain\w*|is (dead|shot|terrible|weak))|run ?time|(only|barely) (lasts?|runs?) (for )?(about )?\d+ min|\d+ minutes? (of )?(run|use|charge)|(doesn'?t|won'?t|will not|does not) (hold|keep) (a |its |the )?charge)",
    "suction_loss": r"\b(lost (its |all )?suction|los(es|ing) suction|no suction|(weak|poor|little|bad|zero) suction|suction (is|was|got|became) (weak|poor|bad|terrible|gone))\b",
    "brush_roll": r"\b(brush ?roll|brushroll|roller ?brush|beater bar|brush (stopped|quit|won'?t|doesn'?t|no longer) (spin|turn|rotat)|roller (stopped|quit|won'?t|doesn'?t))",
    "part_broke": r"\b(hose|wand|handle|latch|hinge|clip|wheel|nozzle|button|switch|trigger|knob|base|attachment) (broke|cracked|snapped|split|fell off|came off|tore|ripped|broke off)|(broke|cracked|snapped) (the |a |my )?(hose|wand|handle|latch|clip|wheel|button)\b",
    "leak": r"\b(leak|leaks|leaking|leaked|leakage)\b",
    "jar_lid_blade": r"\b(pitcher|jar|cup|lid|blade|blades|gasket|seal|carafe) (cracked|crack|broke|leaks?|leaking|rusted|fell apart|stripped|came loose|loose|melted)|(cracked|broken|broke the|loose|dull|rust(y|ed)) (pitcher|jar|cup|lid|blade|blades|gasket|carafe)\b",
    "motor_burn_smell": r"\b(motor (burn\w*|died|blew|smok\w*|quit)|burning smell|burnt smell|burned smell|smell(s|ed)? like (it'?s )?burn\w*|smoke (came|coming|started|pouring)|overheat(s|ed|ing)?)\b",
    "coating_peel": r"\b(coating|non-?stick|teflon|finish|paint|surface) .{0,25}(peel\w*|flak\w*|chip\w*|came off|coming off|wore off|wearing off)|(peel\w*|flak\w*|chipp\w*) .{0,15}(coating|non-?stick|teflon)",
    "error_code": r"\b(error (code|message|light)|flashing (red|lights?)|blinking (red|lights?)|e\d{1,2} (error|code))\b",
    "app_connectivity": r"\b(app (won'?t|doesn'?t|does not|keeps|kept|crash\w*|never|stopped|freez\w*|glitch\w*|is (useless|terrible|horrible|awful|buggy|glitchy|garbage))|(the|shark|ninja) app .{0,40}(won'?t|doesn'?t|can'?t|couldn'?t|not work|never|fail\w*|error)|wifi|wi-fi|bluetooth|(won'?t|can'?t|couldn'?t|would not|unable to|will not) (connect|pair|sync)|connectivity|(lose|loses|lost|losing|drops?) (the )?(connection|wifi|its map|the map|map)|(map|mapping) (fail\w*|never|doesn'?t|won'?t|keeps|disappear\w*|lost|reset\w*|is (terrible|wrong|useless)))",
    "navigation": r"\b(stuck (on|under) (the |a |my )?(rug|rugs|carpet|furniture|couch|bed|chair|cords?|edge|threshold)|can'?t find (its|the) (dock|base|home|charger)|(never|doesn'?t|won'?t|couldn'?t) (find|return to|go back to) (its|the) (dock|base|home|charger)|misses (spots|areas|rooms|half)|bumps into|goes in circles|(runs|drives|goes) around in circles)\b",
    "noise": r"\b(so loud|very loud|extremely loud|too loud|really loud|loud(er)? than|noisy|deafening|high[- ]pitched (noise|whine|sound))\b",
    "heavy_awkward": r"\b(too heavy|very heavy|so heavy|really heavy|heavy and|bulky|top heavy|tips over|falls over|awkward to (use|push|carry|maneuver))\b",
    "not_hot_cook": r"\b(doesn'?t get hot|does not get hot|not hot enough|never gets hot|doesn'?t (heat|stay hot|keep (it|coffee) hot)|lukewarm|takes (forever|too long) to (heat|cook|brew|warm)|undercooked|uneven(ly)? (cook\w*|heat\w*)|burn(s|t|ed) (the )?(food|everything|bottom))\b",
    "no_steam": r"\b(no steam|won'?t steam|doesn'?t steam|does not steam|stopped steaming|barely steams|not (enough|much) steam|little (to no )?steam)\b",
    "clog": r"\b(clog|clogs|clogged|clogging)\b",
    "hair_wrap": r"\b(hair (wraps?|wrapped|tangles?|tangled|gets? (wrapped|tangled|stuck))|tangled (hair|up))\b",
    "hard_to_clean": r"\b(hard to clean|difficult to clean|pain to clean|impossible to clean|nightmare to clean)\b",
    "arrived_damaged_used": r"\b(arrived|came|showed up|received it) (broken|damaged|used|dirty|dented|scratched|cracked|with (hair|dirt|dust|scratches))|(was|is|been) (clearly |obviously )?used before|already registered|previously used|someone else'?s (hair|dirt)",
    "missing_parts": r"\b(missing (parts|pieces|the |a |an |its |attachments|accessories|charger|manual|filter|lid|cord|tank|cap)|(no|without) (charger|manual|instructions|attachments|accessories) (in|was|included|came))",
    "not_as_described": r"\b(not (the )?(as|what) (described|pictured|advertised|ordered|i ordered)|wrong (item|model|product|color|version)|not (really )?(new|refurbished)|isn'?t (new|refurbished))\b",
    "warranty_service": r"\b(customer (service|support) (was|is|were) (terrible|horrible|awful|useless|no help|unhelpful|rude|non-?existent|a joke|the worst)|(terrible|horrible|awful|poor|useless|worst|bad) customer (service|support)|(no|never) (response|responded|called back|heard back)|warranty (claim|replacement|won'?t|wouldn'?t|doesn'?t|did not|didn'?t|refused|denied|voided|expired|ran out|process|is a joke)|out of warranty|(pay|paying|charged?) (to|for) (ship|shipping|return)|refused to (replace|refund|honor))",
}
THEME_GROUPS = {
    "It stopped": ["stopped_working", "dead_on_arrival"],
    "Hardware": ["battery_runtime", "suction_loss", "brush_roll", "part_broke", "leak", "jar_lid_blade", "motor_burn_smell", "coating_peel", "error_code"],
    "In use": ["app_connectivity", "navigation", "noise", "heavy_awkward", "not_hot_cook", "no_steam", "clog", "hair_wrap", "hard_to_clean"],
    "On arrival": ["arrived_damaged_used", "missing_parts", "not_as_described"],
    "Service": ["warranty_service"],
}

# Stated time to failure.
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "a couple": 2, "couple of": 2, "a couple of": 2, "few": 3, "a few": 3,
}
STATED_TIME = (
    r"(?i)\b(?:after|within|in|lasted(?: only| just| about| maybe)?|only|for|less than|under|just (?:over|under|shy of)|about|around|barely|nearly|almost)\s+"
    r"(?:(?:only|just|about|around|maybe|over|under)\s+)?"
    r"(\d{1,2}|a few|a couple of|a couple|couple of|few|a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(day|week|month|year)s?\b"
)
MONTHS_A_UNIT = {"day": 1 / 30.4, "week": 1 / 4.35, "month": 1.0, "year": 12.0}
FAIL_BANDS = [(1, "Under a month"), (4, "1 to 3 months"), (12, "4 to 11 months"), (24, "About a year"), (999, "2 years or more")]
LATEST_FAILURE = 72
AGE_BANDS = [(6, "0 to 6 months"), (12, "7 to 12 months"), (24, "Year 2"), (48, "Years 3 to 4"), (999, "Year 5+")]

# Months on each side of an event, by kind.
EVENT_WINDOWS = {"sibling_launch": 12, "refurbished": 12, "low_rating": 3}

# Names of months, in order.
MONTH_NAMES = [
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"), ("aug", "august"),
    ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
]

# The matcher's grid of weights, and its thresholds in hundredths.
TUNING_GRID = {"jac": [1.0], "cross": [0.0, 0.2, 0.35, 0.5, 0.8], "price": [0.0, 0.15, 0.25, 0.4], "brand": [0.0, 0.1, 0.2], "num": [0.0, 0.1, 0.2, 0.3]}
TUNING_THRESHOLDS = (20, 90, 2)

# Fixed value: the shape of a listing's id.
ID_SHAPE = r"^B0[A-Z0-9]{8}$"

# Fixed value: the precision under which a theme is weak and isn't shown.
WEAK_PRECISION = 0.7

# Types that are shown with "or" for the stroke.
TYPE_LABELS = ["accessory/part", "iron/steamer"]

# Peer titles that are left out, and types.
PEER_EXCLUDED = (
    r"(?i)carpet (cleaner|shampooer|steamer)|shampooer|deep cleaner|spot ?lifter|spot cleaner|crosswave|wet[- ]dry|spinwave|steamshot|hard surface steam cleaner|robot mop|braava|"
    r"air fryer lid|cutting board|steamer basket|steamer insert|accessory bundle|accessor(y|ies)"
)
PEER_DROPPED_TYPES = ["iron/steamer", "sweeper", "accessory/part", "bundle", "unclassified"]
