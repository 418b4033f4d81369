"""Scans of source trees and stored models, and sinks."""
