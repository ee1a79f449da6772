"""Interfaces to outside services.  Engines and tests run without any of them."""

from __future__ import annotations

from typing import Protocol


class Mailbox(Protocol):
    def fetch(self, folder: str) -> list[dict]: ...

    def move(self, uid: str, folder: str) -> None: ...

    def move_by_message_id(self, message_id: str, folder: str) -> bool: ...

    def create_folders(self, names: list[str]) -> None: ...


class Sender(Protocol):
    def send(self, to: list[str], subject: str, html: str, text: str, headers: dict[str, str], attachments: list[str]) -> str: ...


class Accounting(Protocol):
    def query(self, statement: str, parameters: dict[str, str]) -> list[dict]: ...

    def create_receipt(self, payload: str) -> str: ...

    def attach(self, receipt_id: str, path: str) -> None: ...

    def create_customer(self, payload: str) -> str: ...


class Extractor(Protocol):
    """Turns a page image into the text of an extraction record."""

    def extract(self, png: bytes) -> str: ...
