"""The fixed vocabularies of place search, as data: another domain brings its own."""

# Abbreviations by their folded forms.
ABBREVIATIONS = {
    "hcm": "tp hcm", "sg": "tp hcm", "tphcm": "tp hcm", "hcmc": "tp hcm", "sai gon": "tp hcm",
    "hn": "ha noi", "dn": "da nang", "dl": "da lat",
    "cf": "ca phe", "cafe": "ca phe", "cofe": "ca phe", "coffee": "ca phe", "quan cf": "quan ca phe",
    "ks": "khach san", "hotel": "khach san", "nh": "nha hang", "restaurant": "nha hang",
    "tt": "trung tam", "tttm": "trung tam thuong mai", "mall": "trung tam thuong mai",
    "bv": "benh vien", "hospital": "benh vien", "atm": "atm", "gas": "tram xang", "gas station": "tram xang",
}

# Fixed value: the name of an anchor that a query gives by its coordinates.
HERE = "vị trí đã chọn"
# Folded filler words.
STOPWORDS = [
    "o", "cho", "co", "cua", "va", "voi", "de", "tai", "gan", "day", "nay", "do", "ra", "vao", "len", "xuong", "khu", "vuc", "khong", "qua", "cung",
    "hay", "hoac", "mot", "cac", "nhung", "vai", "moi", "noi", "dia", "diem", "quan", "tim", "kiem", "muon", "can", "gi", "nao", "phu", "hop", "the",
    "ngon", "dep", "re", "tot", "sang", "chanh", "xin", "cu", "lon", "nho", "rong", "rai", "sach", "se", "gia", "tieng", "view", "thanh", "an", "uong",
    "mon", "gio",
]

#: Common words, as they are written; none is ever a subject. A longer list is a parameter of the parser.
COMMON = ["nhất", "nhật", "phòng", "trên", "dưới", "trong", "ngoài", "rất", "lắm", "đang", "đã", "sẽ", "mình", "tôi", "bạn", "ai", "đâu", "thì", "là", "bị", "được", "cùng", "theo", "khi", "nếu", "thêm", "cả", "quá", "chưa", "đến"]

# Phrases that name a category.
CATEGORIES = {
    "Quán cà phê": ["quán cà phê", "cà phê", "coffee", "trà sữa", "trà đá", "trà chanh"],
    "Nhà hàng": ["nhà hàng", "quán ăn", "restaurant"],
    "Khách sạn": ["khách sạn", "hotel", "resort"],
    "Trung tâm thương mại": ["trung tâm thương mại", "mall"],
    "ATM": ["atm", "rút tiền"],
    "Trạm xăng": ["trạm xăng", "cây xăng", "tiệm xăng", "xăng dầu"],
    "Công viên": ["công viên", "park"],
    "Bệnh viện": ["bệnh viện", "hospital"],
    "Nhà thuốc": ["nhà thuốc", "hiệu thuốc", "pharmacy"],
    "Rạp phim": ["rạp phim", "rạp chiếu phim", "cinema"],
    "Trạm sạc điện": ["trạm sạc điện", "trạm sạc", "sạc điện"],
    "Điểm tham quan": ["điểm tham quan", "tham quan", "du lịch"],
}
# Phrases of a need that imply a category where none is named.
NEEDS = {
    "Nhà hàng": ["đói bụng", "muốn ăn", "ăn gì", "chỗ ăn", "ăn uống", "ăn ngon", "ăn trưa", "ăn tối", "bữa trưa", "bữa tối"],
    "Quán cà phê": ["khát nước", "khát quá", "muốn uống", "uống gì", "giải khát", "nghỉ chân"],
    "Trạm xăng": ["đổ xăng", "hết xăng", "bơm xăng"],
    "Nhà thuốc": ["mua thuốc", "thuốc cảm", "bị ốm", "bị cảm"],
    "Rạp phim": ["xem phim", "coi phim"],
    "Bệnh viện": ["khám bệnh", "cấp cứu", "đi khám"],
    "Trung tâm thương mại": ["mua sắm", "đi mua đồ"],
    "Trạm sạc điện": ["sạc xe điện", "hết pin xe", "sạc ô tô điện"],
    "Khách sạn": ["qua đêm", "đặt phòng", "nghỉ qua đêm", "chỗ ngủ"],
    "Công viên": ["đi dạo", "hóng mát"],
    "Điểm tham quan": ["chỗ chơi", "đi chơi ở đâu"],
}
# Phrases of the ten attributes.
ATTRIBUTES = {
    "yên tĩnh": ["yên tĩnh", "tĩnh lặng", "quiet"],
    "wifi": ["wifi"],
    "phù hợp làm việc": ["làm việc", "phù hợp làm việc", "work"],
    "phù hợp gia đình": ["gia đình", "phù hợp gia đình", "trẻ em"],
    "lãng mạn": ["lãng mạn", "hẹn hò", "romantic"],
    "mở khuya": ["mở khuya", "khuya", "late"],
    "gần biển": ["gần biển", "view biển", "beach"],
    "bãi đỗ xe": ["bãi đỗ xe", "đỗ xe", "parking"],
    "check-in": ["check in", "sống ảo", "view đẹp"],
    "24/7": ["24/7"],
}
# Phrases of price directions, and of the nearest one.
PRICES = {
    "cheap": ["giá rẻ", "bình dân", "tiết kiệm", "rẻ", "cheap", "budget"],
    "expensive": ["sang trọng", "sang chảnh", "cao cấp", "sang", "luxury"],
}
NEAREST = ["gần nhất", "gần đây nhất", "nearest", "closest"]
# Landmarks with latitude and longitude.
LANDMARKS = [
    ("Hồ Gươm", 21.0287, 105.8524), ("Hồ Hoàn Kiếm", 21.0287, 105.8524), ("Hồ Tây", 21.0587, 105.8190),
    ("Phố Cổ", 21.0334, 105.8500), ("Chợ Bến Thành", 10.7723, 106.6980), ("Phố đi bộ Nguyễn Huệ", 10.7745, 106.7040),
    ("Bến Thành", 10.7723, 106.6980), ("Biển Mỹ Khê", 16.0545, 108.2470), ("Cầu Rồng", 16.0611, 108.2270),
    ("Hồ Xuân Hương", 11.9416, 108.4383), ("Chợ Đà Lạt", 11.9430, 108.4370),
]


def keys(table: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    """(order, phrase, value) in the order in which they are listed."""
    return [(i, k, v) for i, (k, v) in enumerate((k, v) for v, ks in table.items() for k in ks)]
