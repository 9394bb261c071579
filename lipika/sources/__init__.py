"""Files, folders and extracted pages as documents; tables to and from folders."""

from .files import directory_documents, documents_of_pages, load, page_rows, save, text_documents

__all__ = ["directory_documents", "documents_of_pages", "load", "page_rows", "save", "text_documents"]
