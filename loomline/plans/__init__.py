"""Queries on the driver tables; importing the package registers all of them."""

from loomline.plans import bindings, linked, streams, texts  # noqa: F401
