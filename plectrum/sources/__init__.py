"""plectrum.sources"""
