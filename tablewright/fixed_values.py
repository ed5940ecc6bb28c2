"""Names, words and defaults that stored snapshots are matched against."""

# Hours-page name -> menu-site name.
CROSSWALK = {
    "Bella Union": "Bella Union",
    "Beyu Blue Coffee": "Beyu Blue Coffee",
    "Bseisu Coffee Bar": "Bseisu Coffee Bar",
    "Cafe": "Cafe",
    "Cafe' 300": "Café 300",
    "Freeman Center for Jewish Life": "Freeman Café",
    "Ginger & Soy": "Ginger + Soy",
    "Gothic Grill": "Gothic Grill",
    "Gyotaku": "Gyotaku",
    "Il Forno": "Il Forno",
    "It's Thyme": "It's Thyme",
    "JB's Roasts and Chops": "J.B.'s Roast & Chops",
    "Marketplace": "Marketplace",
    "Nasher Museum Cafe": "Nasher Museum Café",
    "Red Mango Cafe": "Red Mango",
    "Saladelia Cafe at Perkins": "Saladalia @ The Perk",
    "Saladelia Cafe at Sanford": "Sanford Deli",
    "Sazon": "Sazon",
    "Sprout": "Sprout",
    "Tandoor": "Tandoor Indian Cuisine",
    "The Devil's Krafthouse": "The Devils Krafthouse",
    "Farmstead": "The Farmstead",
    "Pitchfork's": "The PitchFork",
    "The Skillet": "The Skillet",
    "Trinity Cafe": "Trinity Cafe",
    "Twinnie's": "Twinnie's",
    "Zweli's Cafe at Duke Divinity": "Zweli's Café at Duke Divinity",
}

# Nutrients printed in bold on a label.
MAJOR_NUTRIENTS = (
    "Total Fat",
    "Cholesterol",
    "Sodium",
    "Total Carbohydrate",
    "Total Carbohydrates",
    "Protein",
)

# Words that make an unlabelled line a serving size.
SERVING_UNITS = ("oz", "g", "ml", "cup", "piece", "slice", "tbsp", "tsp", "fl oz", "lb", "lbs", "portion")

# Daily timetable slots in order, and the informational one.
SLOTS = ("Fajr", "Dhuhr", "Asr", "Maghrib", "Isha")
SUNRISE = "Sunrise"

# Texts and zone that stored snapshots use.
ZONE = "America/New_York"
HOURS_MISSING = "Hours not available"
NO_ITEMS = "There are no items available"
UNCATEGORIZED = "Uncategorized"
NAME_MISSING = "Unknown"
FLAG_WORD = "halal"
RSVP_PATTERN = r"https?://[\w.-]+/rsvp\?id=\d+"
SLOT_MINUTES = 5
FLAG_COLOURS = ("lightgreen", "salmon")

# Classes of the rows and links of a menu page.
MENU_TABLE = "table"
MENU_GROUP_ROW = "itemGroupRow"
MENU_ITEM_ROWS = ("itemPrimaryRow", "itemAlternateRow")
MENU_LINK = "cbo_nn_itemHover"
# Start of the id of the link that opens an item's label.
LABEL_LINK = "showNutrition_"

# Classes of the parts of a label page.
LABEL_PARTS = {
    "name": "cbo_nn_LabelHeader",
    "serving": "cbo_nn_LabelBottomBorderLabel",
    "ingredients": "cbo_nn_LabelIngredients",
    "allergens": "cbo_nn_LabelAllergens",
}
LABEL_CALORIES = ("cbo_nn_LabelSubHeader", "font-22")
LABEL_ROW = "cbo_nn_LabelBorderedSubHeader"
LABEL_PLAIN_ROW = "cbo_nn_LabelNoBorderSubHeader"
LABEL_SECONDARY = "cbo_nn_LabelSecondaryTable"
LABEL_SIDES = ("inline-div-left", "inline-div-right")

# Phrases of a label.
SERVINGS_PHRASE = "Servings per container"
SIZE_PHRASE = "Serving Size"
SKIPPED_FACT = "Include NA"
