"""Code-uncertainty analytics as Spark plans: token streams to blocks, trees and scores; snapshots to deltas and rankings."""
