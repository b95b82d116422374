"""creditspark.functions"""
