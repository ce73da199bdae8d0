"""Messages told to users as a project moves on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# One text per stage. {project}, {error} and the three place
# names are filled in; the rest must stay as it is.
MESSAGES = {
    "project_created": "系统已创建新的项目: {project}",
    "config_missing": "{project}: 收到新的检索式，但文件不存在或未直接将文件放置在config目录下。",
    "config_bad_format": "{project}: 收到新的检索式，但是文件格式不正确。请检查文件格式是否为bib, json或yaml。",
    "config_received": "{project}: 收到新的检索式，正在处理。",
    "config_unreadable": "{project}: 文件格式不正确。请检查文件格式是否为bib, json或yaml。",
    "destination_exists": "{project}: 系统检测到在metadata目录已有同名的Metadata文件, 请重命名配置文件后重试。",
    "config_parsed": "{project}: 解析配置文件成功",
    "metadata_ready": "{project}: 系统已获取到新的文献元数据。正在下载文献PDF，请稍后。",
    "query_done": "{project}: 系统已处理完毕新的检索式。请前往{site}下载Metadata，并导入至{studio}。",
    "pdf_downloaded": "{project}: 系统已下载完所有文献PDF。请前往{studio}查看。",
    "pdf_received": "{project}: 系统已获取到新的文献PDF。正在转换为HTML，请稍后。",
    "pdf_converted": "{project}: 系统已将所有文献PDF转换为HTML。请前往{studio}查看。",
    "failed": "{project}: 系统处理时出现了错误。请管理员前往{server}查看错误信息。以下是错误信息：\n{error}",
}

DEFAULT_PLACES = {"site": "下载站点", "studio": "标注平台", "server": "服务器"}


def status_message(
    stage: Column,
    project: Column,
    error: Column | None = None,
    places: dict[str, str] | None = None,
) -> Column:
    """Message of a stage; null for an unknown stage.

    ``places`` names the site, studio and server users are sent to.
    """
    names = {**DEFAULT_PLACES, **(places or {})}
    texts = {k: fill_places(v, names) for k, v in MESSAGES.items()}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(texts.items())])
    message = F.replace(F.try_element_at(lookup, stage), F.lit("{project}"), project)
    reason = F.lit("") if error is None else F.coalesce(error, F.lit(""))
    return F.replace(message, F.lit("{error}"), reason)


def fill_places(text: str, names: dict[str, str]) -> str:
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text
