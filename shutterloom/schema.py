"""Schemas, enumerations and labels of the media catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a capture time of each source is trusted.
TIME_CONFIDENCE = {"exif": 5, "container": 4, "fileName": 3, "fileSystem": 1, "none": 0}
#: File name endings of the two visual kinds.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "jpe", "jfif", "png", "heic", "heif", "tif", "tiff", "gif", "bmp", "webp", "ico", "avif", "dng", "cr2", "cr3", "nef", "arw", "raf", "rw2", "orf", "srw", "pef", "x3f")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "3gp", "3g2", "qt", "mts", "m2ts", "m2t", "ts", "mkv", "avi", "wmv", "flv", "webm", "mpg", "mpeg", "mpe", "vob", "ogv", "mxf", "divx", "asf", "rm", "rmvb")
#: Labels that get into paths; callers may pass others.
KIND_LABELS = {"image": "图片", "video": "视频", "other": "其他"}
UNKNOWN_DEVICE, UNKNOWN_MAKE, UNKNOWN_MODEL, UNKNOWN_LENS = "未知设备", "未知厂商", "未知型号", "未知镜头"
UNKNOWN_DATE_FOLDER, ROOT_FOLDER = "未识别日期", "根目录"
#: Texts of a plan, as the catalogue's users know them.
GROUP_LABELS = {"exact": "完全重复", "similarImage": "相似图片", "similarVideo": "相似视频"}
NOTES = {
    "replaced": "（同名文件将先移入回收站，再落位）",
    "in_batch": "（与本次计划内其他文件重名，自动加序号）",
    "claimed": "（目标位置的文件本次也要移动，自动加序号）",
    "on_disk": "（目标已存在，自动加序号）",
}
REASONS = {
    "discardAll": " · 已设为整组都不保留",
    "kept": "冗余副本 · 同组保留「",
    "unnamed": "组内保留项",
    "several": (" 等 ", " 份"),
    "by_device": "按设备归档：",
    "taken": "拍摄时间 ",
    "source": "（来源：",
    "no_time": "拍摄时间未识别",
    "renamed": "按命名规则重命名",
    "gps": "含 GPS",
    "placed": "已在目标位置，无需处理",
    "skipped": "目标已存在，按策略跳过",
}
#: What a journal says of failures and of files that made room, and an undo of what it couldn't take back or put elsewhere.
MESSAGES = {
    "no_source": "源文件已不存在",
    "no_destination": "缺少目标路径",
    "occupied": "目标已存在同名文件，未执行",
    "displaced": "被同名文件顶替，已移入回收站（撤销可取回）",
    "undo_failed": "撤销失败：",
    "undo_gone": "目标位置的副本已不存在，无法还原",
    "undo_untold": "日志未记录回收站位置，请手动从回收站取回",
    "undo_emptied": "回收站中的文件已被清空，无法还原",
    "undo_occupied": "原位置已存在同名文件，未还原以免覆盖",
    "undo_renamed": "原位置已被占用，已还原为 ",
}
MUTATING = ("move", "rename", "copy", "trash")

JOURNAL_SCHEMA = "id string, timestamp string, kind string, sourcePath string, destinationPath string, result string, message string, fileSize long, trashPath string, undone boolean"


def confidence(time_source: Column) -> Column:
    """Trust in a capture time by its source; 0 for null and unknown sources."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TIME_CONFIDENCE.items() for x in kv])[time_source], F.lit(0))


def is_visual(kind: Column) -> Column:
    return F.coalesce(kind.isin("image", "video"), F.lit(False))
