"""Closed vocabularies and lookup tables of the floor-plan model."""

# Element labels by class id (0-based).
LABELS = [
    "single door",
    "double door",
    "sliding door",
    "folding door",
    "revolving door",
    "rolling door",
    "window",
    "bay window",
    "blind window",
    "opening symbol",
    "sofa",
    "bed",
    "chair",
    "table",
    "TV cabinet",
    "Wardrobe",
    "cabinet",
    "gas stove",
    "sink",
    "refrigerator",
    "airconditioner",
    "bath",
    "bath tub",
    "washing machine",
    "urinal",
    "squat toilet",
    "toilet",
    "stairs",
    "elevator",
    "escalator",
    "row chairs",
    "parking spot",
    "wall",
    "curtain wall",
    "railing",
]
# Label sets.
BOUNDARY_LABELS = ["wall", "curtain wall", "railing", "window", "bay window", "blind window"]
OPENING_LABELS = ["single door", "double door", "sliding door", "folding door", "revolving door", "rolling door", "opening symbol"]
WINDOW_LABELS = ["window", "bay window", "blind window"]
# Labels of texts and of what is none.
TEXT_LABEL = "room_label"
BACKGROUND = "background"

# The sets of room types that decide what is public.
UNKNOWN = "Unknown"
PUBLIC_SEEDS = ["ElevatorShaft", "Stairwell", "WaterRoom", "ElectricalRoom", "VentilationRoom", "EquipmentRoom", "Exterior"]
PRIVATE_SEEDS = ["Bedroom", "LivingRoom", "Kitchen", "Bathroom", "DiningRoom", "Cloakroom", "StudyRoom", "Balcony", "Entrance"]
PUBLIC_BLOCKERS = [*PUBLIC_SEEDS, "PublicCorridor", UNKNOWN]
# Fixed value: the node outside all rooms.
EXTERIOR_ID = "UnmodeledExterior"

# Layers of annotated drawings.
ROOM_LAYERS = {
    "GT_BEDROOM": "Bedroom", "GT_卧室": "Bedroom",
    "GT_LIVINGROOM": "LivingRoom", "GT_客厅": "LivingRoom",
    "GT_KITCHEN": "Kitchen", "GT_厨房": "Kitchen",
    "GT_BATHROOM": "Bathroom", "GT_卫生间": "Bathroom",
    "GT_BALCONY": "Balcony", "GT_阳台": "Balcony",
    "GT_CORRIDOR": "Corridor", "GT_过道": "Corridor",
    "GT_ENTRANCE": "Entrance", "GT_玄关": "Entrance",
    "GT_GARDEN": "Garden", "GT_花园": "Garden",
    "GT_DININGROOM": "DiningRoom", "GT_餐厅": "DiningRoom",
    "GT_ELEVATORSHAFT": "ElevatorShaft", "GT_电梯": "ElevatorShaft",
    "GT_STORAGEROOM": "StorageRoom", "GT_储藏间": "StorageRoom",
    "GT_STAIRWELL": "Stairwell", "GT_楼梯": "Stairwell",
    "GT_CLOAKROOM": "Cloakroom", "GT_衣帽间": "Cloakroom",
    "GT_STUDYROOM": "StudyRoom", "GT_书房": "StudyRoom",
    "GT_SUNROOM": "SunRoom", "GT_阳光房": "SunRoom",
    "GT_WATERROOM": "WaterRoom", "GT_水机房": "WaterRoom",
    "GT_ELECTRICALROOM": "ElectricalRoom", "GT_电机房": "ElectricalRoom",
    "GT_VENTILATIONROOM": "VentilationRoom", "GT_风机房": "VentilationRoom",
}
DOOR_LAYERS = ["GT_DOOR", "GT_门"]
FACILITY_LAYERS = {
    "GT_SINK": "beo:Sink", "GT_水槽": "beo:Sink",
    "GT_BATHTUB": "beo:Bathtub", "GT_浴缸": "beo:Bathtub",
    "GT_BATH": "beo:Bath", "GT_洗浴区": "beo:Bath",
    "GT_GASSTOVE": "beo:GasStove", "GT_燃气灶": "beo:GasStove",
    "GT_TOILET": "beo:Toilet", "GT_便器": "beo:Toilet",
}

# Room texts that are mapped when no mapping table is given, and the text that is no room's.
DEFAULT_TEXTS = {"次卧": "Bedroom", "主卫": "Bathroom", "餐客厅": "LivingRoom"}
STOP_TEXT = "标注"
