"""frameloom.sources"""
