"""lamina: analytics over spatial measurements, event sequences, trees and text, written as Spark plans."""
